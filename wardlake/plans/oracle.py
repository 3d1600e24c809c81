"""DuckDB SQL that states the result of each registered query on the same tables."""

from __future__ import annotations

# Names of the columns of a clean visit, in table order.
VISIT_COLUMNS = [
    "patient_id", "admission_datetime", "first_initial", "last_name", "gender", "age", "race",
    "department_referral", "admission_flag", "satisfaction_score", "wait_time",
    "coordinator_manager_flag", "doctor_id", "source_file", "source_row", "visit_id",
    "bronze_timestamp",
]
# Payload key of the text columns.
KEYS = {
    "patient_id": "patient_id", "admission_datetime": "patient_admission_date",
    "first_initial": "patient_first_inital", "last_name": "patient_last_name",
    "gender": "patient_gender", "age": "patient_age", "race": "patient_race",
    "department_referral": "department_referral", "admission_flag": "patient_admission_flag",
    "satisfaction_score": "patient_satisfaction_score", "wait_time": "patient_waittime",
    "coordinator_manager_flag": "patients_cm", "doctor_id": "doctor_id", "source_file": "file",
    "source_row": "row",
}
TIME_FORM = "%Y-%m-%d %H:%M:%S.%f"


def at(column: str) -> str:
    """A timestamp as text under its own name."""
    return f"strftime({column}, '{TIME_FORM}') AS {column}"


def stamp(column: str) -> str:
    return f"replace(strftime({column}, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '') || '+00:00'"


def pick(number: str, *choices: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices))
    return f"CASE {number} % {len(choices)} {whens} END"


def texts(*values: str) -> list[str]:
    return ["'" + v.replace("'", "''") + "'" for v in values]


def rounded(x: str, digits: int) -> str:
    return f"round(cast(cast({x} AS varchar) AS decimal(38,18)), {digits})::double"


def title(x: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({x}, ' '), "
        "lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"
    )


_forms = [
    "%Y-%m-%d %H:%M:%S", "%d-%m-%Y %H:%M", "%d-%m-%Y %H:%M:%S", "%d/%m/%Y %H:%M",
    "%d/%m/%Y %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%d-%m-%Y", "%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y",
]
_t = "ts + to_days(((user_id % 12) * 30)::int)"

CELLS = f"""
cells AS (
  SELECT
    CASE WHEN event_id % 97 = 0 THEN 'N/A' ELSE 'P' || user_id END AS patient_id,
    {pick("event_id", *[f"strftime({_t}, '{f}')" for f in _forms], "'not-a-date'")} AS patient_admission_date,
    {pick("event_id", *texts("ab", "Q", " x", ""))} AS patient_first_inital,
    {pick("user_id", *texts("SMITH", "o'neil", "de la CRUZ", "Jones-lee", "None"))} AS patient_last_name,
    {pick("event_id", *texts("Male", "f", "F", "Unknown", "x"))} AS patient_gender,
    CASE WHEN event_id % 37 = 0 THEN 'abc' WHEN event_id % 41 = 0 THEN '130'
         WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') || '.7'
         ELSE json_extract_string(props, '$.k') END AS patient_age,
    {pick("event_id", *texts("white", "BLACK", "asian", "native american", "N/A", "other"))} AS patient_race,
    {pick("event_id", *texts("cardiology", "NEUROLOGY", "Orthopedics", "physiotherapy", "N/A"),
          "event_type", "event_type", "event_type", "'general practice'")} AS department_referral,
    {pick("event_id", *texts("Y", "yes", "true", "1", "N", "false", "0", "maybe"))} AS patient_admission_flag,
    CASE WHEN event_id % 11 = 0 THEN '' ELSE (event_id * 7 % 13)::varchar END AS patient_satisfaction_score,
    CASE WHEN event_id % 53 = 0 THEN '-5' ELSE floor(value)::bigint::varchar END AS patient_waittime,
    {pick("event_id", *texts("true", "false", "N/A"))} AS patients_cm,
    'DOC-' || user_id AS doctor_id,
    'events.csv' AS file,
    (event_id + 1)::int AS row,
    ts AS arrived
  FROM events
), sent AS (
  SELECT * FROM cells
  UNION ALL
  SELECT * REPLACE (arrived + INTERVAL 1 HOUR AS arrived) FROM cells WHERE (row - 1) % 50 >= 45
)"""

_line = "json_object(" + ", ".join(f"'{k}', {k}" for k in KEYS.values()) + ")::varchar"
LINES = f"""{CELLS}, lines AS (SELECT row, {_line} AS value, arrived FROM sent)"""

TEXTS = f"""{CELLS}, texts AS (
  SELECT {", ".join(f"{k}::varchar AS {c}" for c, k in KEYS.items())},
         {stamp("arrived")} AS timestamp_bronze, arrived
  FROM sent
)"""

MARKED = f"""{TEXTS}, marked AS (
  SELECT {", ".join(f"CASE WHEN {c} NOT IN ('N/A', 'Unknown', 'None', '', ' ') THEN {c} END AS {c}"
                    for c in [*KEYS, "timestamp_bronze"])}, arrived
  FROM texts
)"""

_number = "trunc(try_cast({0} AS double))::int AS {0}"
CLEAN = f"""{MARKED}, typed AS (
  SELECT patient_id,
    try_strptime(admission_datetime, [{", ".join(f"'{f}'" for f in _forms)}]) AS admission_datetime,
    upper(left(first_initial, 1)) AS first_initial,
    {title("last_name")} AS last_name,
    CASE lower(left(gender, 1)) WHEN 'm' THEN 'male' WHEN 'f' THEN 'female' END AS gender,
    {_number.format("age")},
    {title("race")} AS race,
    {title("department_referral")} AS department_referral,
    CASE WHEN lower(admission_flag) SIMILAR TO '[yt].*|1' THEN true
         WHEN lower(admission_flag) SIMILAR TO '[nf].*|0' THEN false END AS admission_flag,
    {_number.format("satisfaction_score")},
    {_number.format("wait_time")},
    try_cast(coordinator_manager_flag AS boolean) AS coordinator_manager_flag,
    doctor_id, source_file, try_cast(source_row AS int) AS source_row,
    arrived AS bronze_timestamp
  FROM marked
), clean AS (
  SELECT *, sha256(concat_ws('|', patient_id, strftime(admission_datetime, '%Y-%m-%d %H:%M:%S'))) AS visit_id
  FROM typed
), kept AS (SELECT * FROM clean WHERE patient_id IS NOT NULL)"""


def current(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT * EXCLUDE (newest) FROM (
    SELECT *, row_number() OVER (PARTITION BY visit_id
             ORDER BY bronze_timestamp DESC, source_file DESC, source_row DESC) AS newest
    FROM {source}) WHERE newest = 1
)"""


VISITS = f"{CLEAN}, {current('visits', 'kept')}"

_departments = texts(*[f" {d} " for d in (
    "cardiology", "emergency medicine", "neurology", "physiotherapy", "gastroenterology",
    "general practice", "orthopedics")])
_groups = [f"dept_{d.strip(" '").replace(' ', '_')}" for d in _departments]
DOCTORS_RAW = f"""doctors_raw AS (
  SELECT CASE WHEN s_suppkey % 37 = 36 THEN NULL WHEN s_suppkey % 43 = 42 THEN 'BAD' || s_suppkey
              ELSE ' doc-' || s_suppkey || ' ' END AS doctor_id,
    ' ethan ' AS doctor_first_name,
    CASE WHEN s_suppkey % 41 <> 40 THEN s_name END AS doctor_last_name,
    {pick("s_nationkey", *_departments)} AS department,
    n_name AS subspecialty,
    'U' || (s_suppkey % 5) AS university,
    (CASE WHEN s_suppkey % 29 = 28 THEN -1 ELSE s_suppkey % 30 END)::int AS years_of_experience
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
)"""
DOCTORS = f"""{DOCTORS_RAW}, doctors_clean AS (
  SELECT upper(trim(doctor_id)) AS doctor_id,
    {title("trim(doctor_first_name)")} AS doctor_first_name,
    {title("trim(doctor_last_name)")} AS doctor_last_name,
    {title("trim(department)")} AS department, subspecialty, university, years_of_experience
  FROM doctors_raw
), doctors AS (SELECT * FROM doctors_clean WHERE doctor_id IS NOT NULL)"""


def enriched(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT visit_id, admission_datetime, age, gender, race, admission_flag, satisfaction_score, wait_time,
    coalesce(department_referral, 'No referral') AS department_referral,
    coordinator_manager_flag::int AS coordinator_involved,
    v.doctor_id, doctor_first_name, doctor_last_name, department, subspecialty, university,
    years_of_experience,
    date_trunc('month', admission_datetime)::date AS admission_month,
    hour(admission_datetime)::int AS admission_hour,
    (dayofweek(admission_datetime) + 1)::int AS weekday_num,
    strftime(admission_datetime, '%a') AS weekday,
    CASE WHEN age < 18 THEN '0-17' WHEN age < 40 THEN '18-39' WHEN age < 65 THEN '40-64'
         WHEN age >= 65 THEN '65+' END AS age_group,
    CASE WHEN wait_time <= 15 THEN '00-15' WHEN wait_time <= 30 THEN '16-30'
         WHEN wait_time <= 45 THEN '31-45' WHEN wait_time >= 46 THEN '46+' END AS wait_bucket_in_mins,
    CASE WHEN years_of_experience <= 10 THEN '0-10' WHEN years_of_experience <= 15 THEN '11-15'
         WHEN years_of_experience IS NOT NULL THEN '16+' END AS experience_bucket_in_years
  FROM {source} v LEFT JOIN doctors d ON v.doctor_id = d.doctor_id
)"""


GOLD = f"{VISITS}, {DOCTORS}, {enriched('gold', 'visits')}"
GOLD_COLUMNS = f"* REPLACE ({at('admission_datetime')}, admission_month::varchar AS admission_month)"

MEASURES = {
    "visits": "count(*) AS visits",
    "avg_wait_time": f"{rounded('avg(wait_time)', 1)} AS avg_wait_time",
    "avg_satisfaction": f"{rounded('avg(satisfaction_score)', 2)} AS avg_satisfaction",
    "satisfaction_responses": "count(satisfaction_score) AS satisfaction_responses",
    "admission_rate_pct": f"{rounded('100 * avg(admission_flag::int)', 1)} AS admission_rate_pct",
    "coordinator_usage_pct": f"{rounded('100 * avg(coordinator_involved)', 1)} AS coordinator_usage_pct",
    "avg_age": f"{rounded('avg(age)', 1)} AS avg_age",
}


def measures(*names: str) -> str:
    return ", ".join(MEASURES[n] for n in names)


DOCTOR_KEYS = (
    "doctor_id, doctor_first_name, doctor_last_name, department, subspecialty, university, "
    "years_of_experience"
)


def monthly(source: str) -> str:
    return f"""SELECT department_referral, admission_month, {measures(*MEASURES)}
      FROM {source} GROUP BY department_referral, admission_month"""


def performance(source: str) -> str:
    return f"""SELECT {DOCTOR_KEYS}, {measures("visits", "avg_wait_time", "avg_satisfaction",
        "satisfaction_responses", "admission_rate_pct", "coordinator_usage_pct")}
      FROM {source} GROUP BY {DOCTOR_KEYS}"""


BY_HOUR = f"""SELECT weekday_num, weekday, admission_hour, {measures("visits", "avg_wait_time")}
      FROM gold GROUP BY weekday_num, weekday, admission_hour"""

ROLLED = f"""{GOLD}, monthly AS ({monthly("gold")}), performance AS ({performance("gold")}),
  by_hour AS ({BY_HOUR})"""


def na(x: str) -> str:
    return f"coalesce({x}::varchar, 'n/a')"


def department_docs(source: str) -> str:
    return f"""SELECT concat_ws('-', 'dept', department_referral, admission_month::varchar) AS doc_id,
    'department_month' AS doc_type, department_referral AS department,
    admission_month::varchar AS period,
    'In ' || {na("admission_month")} || ', the ' || {na("department_referral")} || ' department had ' ||
    {na("visits")} || ' visits, an average wait time of ' || {na("avg_wait_time")} ||
    ' minutes, an average satisfaction score of ' || {na("avg_satisfaction")} || ' (' ||
    {na("satisfaction_responses")} || ' responses), an admission rate of ' || {na("admission_rate_pct")} ||
    '% and coordinator usage of ' || {na("coordinator_usage_pct")} || '%. Average patient age was ' ||
    {na("avg_age")} || '.' AS text
  FROM {source}"""


def doctor_docs(source: str) -> str:
    return f"""SELECT concat_ws('-', 'doctor', doctor_id) AS doc_id, 'doctor' AS doc_type, department,
    NULL::varchar AS period,
    'Dr. ' || {na("doctor_first_name")} || ' ' || {na("doctor_last_name")} || ' works in ' ||
    {na("department")} || ' (' || {na("subspecialty")} || '), studied at ' || {na("university")} ||
    ' and has ' || {na("years_of_experience")} || ' years of experience. Across ' || {na("visits")} ||
    ' visits: average wait time ' || {na("avg_wait_time")} || ' minutes, average satisfaction ' ||
    {na("avg_satisfaction")} || ' (' || {na("satisfaction_responses")} || ' responses), admission rate ' ||
    {na("admission_rate_pct")} || '%, coordinator usage ' || {na("coordinator_usage_pct")} || '%.' AS text
  FROM {source}"""


DOCS = f"""{ROLLED}, docs AS ({department_docs("monthly")} UNION ALL {doctor_docs("performance")})"""

EARLIER = f"""{DOCS}, kept_then AS (SELECT * FROM kept WHERE bronze_timestamp < TIMESTAMP '2024-01-30 12:00:00'),
  {current("visits_then", "kept_then")}, {enriched("gold_then", "visits_then")},
  monthly_then AS ({monthly("gold_then")}), performance_then AS ({performance("gold_then")}),
  earlier AS (
    {department_docs("(SELECT * REPLACE (CASE WHEN department_referral = 'Orthopedics' "
                     "THEN 'Closed Ward' ELSE department_referral END AS department_referral) "
                     "FROM monthly_then)")}
    UNION ALL {doctor_docs("performance_then")}
  ), feed AS (
    SELECT coalesce(o.doc_id, n.doc_id) AS doc_id,
      CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete'
           WHEN o.text IS NOT DISTINCT FROM n.text AND o.department IS NOT DISTINCT FROM n.department
            AND o.period IS NOT DISTINCT FROM n.period AND o.doc_type IS NOT DISTINCT FROM n.doc_type
           THEN 'unchanged' ELSE 'update' END AS op,
      CASE WHEN n.doc_id IS NULL THEN o.text ELSE n.text END AS text,
      CASE WHEN n.doc_id IS NULL THEN o.department ELSE n.department END AS department,
      CASE WHEN n.doc_id IS NULL THEN o.period ELSE n.period END AS period,
      CASE WHEN n.doc_id IS NULL THEN o.doc_type ELSE n.doc_type END AS doc_type
    FROM earlier o FULL OUTER JOIN docs n ON o.doc_id = n.doc_id
  )"""


# CRC-32 of a word, byte by byte with the usual table of 256 remainders.
CRC = """crc_table AS (
    SELECT list(v ORDER BY i) AS t FROM (
      SELECT i, list_reduce(list_concat([i], range(8)),
        lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
      FROM range(256) AS r(i))
  )"""


def word_vectors(name: str, source: str, key: str, text: str) -> str:
    """Sparse unit vectors of hashed word counts, rounded to single precision."""
    return f"""{name}_words AS (
    SELECT id, word, count(*) AS n FROM (
      SELECT {key} AS id, unnest(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+')) AS word
      FROM {source}) WHERE word <> '' GROUP BY id, word
  ), {name}_slots AS (
    SELECT word, xor(list_reduce(
        list_concat([4294967295], list_transform(range(strlen(word)),
          lambda b: ('0x' || substr(hex(encode(word)), 2 * b + 1, 2))::bigint)),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 256 AS slot
    FROM (SELECT DISTINCT word FROM {name}_words), crc_table
  ), {name} AS (
    SELECT id, slot, (n / sqrt(sum(n * n) OVER (PARTITION BY id)))::float AS weight FROM (
      SELECT id, slot, sum(n)::double AS n FROM {name}_words JOIN {name}_slots USING (word)
      GROUP BY id, slot)
  )"""


QUESTIONS = """questions AS (
  SELECT DISTINCT 'wait-' || department_referral AS question_id,
    'What is the average wait time in the ' || department_referral || ' department?' AS question
  FROM gold
)"""

RETRIEVED = f"""{DOCS}, {CRC}, {QUESTIONS}, {word_vectors("q", "questions", "question_id", "question")},
  {word_vectors("d", "docs", "doc_id", "text")},
  norms AS (SELECT 'q' AS side, id, sqrt(sum(weight::double * weight::double)) AS norm FROM q GROUP BY id
    UNION ALL SELECT 'd', id, sqrt(sum(weight::double * weight::double)) FROM d GROUP BY id),
  dots AS (SELECT q.id AS question_id, d.id AS doc_id, sum(q.weight::double * d.weight::double) AS dot
    FROM q JOIN d ON q.slot = d.slot GROUP BY q.id, d.id),
  scored AS (SELECT questions.question_id, docs.doc_id, docs.text,
      round(coalesce(dot / (nq.norm * nd.norm), 0), 12) AS score
    FROM questions CROSS JOIN docs
    LEFT JOIN dots ON dots.question_id = questions.question_id AND dots.doc_id = docs.doc_id
    LEFT JOIN norms nq ON nq.side = 'q' AND nq.id = questions.question_id
    LEFT JOIN norms nd ON nd.side = 'd' AND nd.id = docs.doc_id),
  found AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id)::int AS rank
    FROM scored) WHERE rank <= 6),
  contexts AS (SELECT question_id, string_agg('[' || doc_id || '] ' || text, chr(10) ORDER BY rank) AS context
    FROM found GROUP BY question_id)"""

_visit_list = ", ".join(
    at(c) if c in ("admission_datetime", "bronze_timestamp") else c for c in VISIT_COLUMNS
)
_doctor_list = "doctor_id, doctor_first_name, doctor_last_name, department, subspecialty, university, years_of_experience"

# Names and conditions of the rules.
VISIT_RULES = {
    "existing patient_id": "patient_id IS NOT NULL",
    "age check": "age IS NULL OR (age >= 0 AND age < 120)",
    "satisfaction score check": "satisfaction_score IS NULL OR satisfaction_score BETWEEN 0 AND 10",
    "wait time check": "wait_time IS NULL OR wait_time >= 0",
    "doctor id exists": "doctor_id IS NOT NULL",
}
DOCTOR_RULES = {
    "existing doctor_id": "doctor_id IS NOT NULL",
    "doctor_id format": "regexp_matches(doctor_id, '^DOC-[0-9]+$')",
    "last name not null": "doctor_last_name IS NOT NULL",
    "experience non-negative": "years_of_experience IS NULL OR years_of_experience >= 0",
}


def report(rules: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) FILTER (coalesce({rule}, false)) AS passed, "
        f"count(*) FILTER (NOT coalesce({rule}, false)) AS failed FROM {source}"
        for name, rule in rules.items()
    )


def failing(rules: dict[str, str], source: str, columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS rule, {columns} FROM {source} WHERE NOT coalesce({rule}, false)"
        for name, rule in rules.items()
    )


def clean_of(*columns: str) -> str:
    """Raw and clean values of some columns, with the row they came from."""
    picked = ", ".join(f"m.{c} AS raw_{c}, " + (
        f"strftime(c.{c}, '{TIME_FORM}') AS {c}" if c == "admission_datetime" else f"c.{c}"
    ) for c in columns)
    return f"""WITH {CLEAN} SELECT c.source_row, strftime(c.bronze_timestamp, '{TIME_FORM}') AS bronze_timestamp,
      {picked} FROM clean c JOIN texts m ON m.source_row::int = c.source_row AND m.arrived = c.bronze_timestamp"""


def visible(department: str, groups: list[str]) -> str:
    listed = ", ".join(f"'{g}'" for g in groups)
    return f"'dept_' || lower(replace({department}, ' ', '_')) IN ({listed})"


def secured_visits(admin: bool, groups: list[str]) -> str:
    hidden = ("patient_id", "first_initial", "last_name")
    columns = ", ".join(
        f"'***' AS {c}" if c in hidden and not admin
        else at(c) if c in ("admission_datetime", "bronze_timestamp") else c
        for c in VISIT_COLUMNS
    )
    rows = "true" if admin else visible("department_referral", groups) if groups else "false"
    return f"WITH {VISITS} SELECT {columns} FROM visits WHERE {rows}"


_cell_columns = [k for k in KEYS.values() if k not in ("file", "row")]
_broken = "patient_last_name || chr(10) || '\"' || patient_race || '\"' || chr(13) || chr(10) || patient_race || chr(13)"
_cells = f"WITH {CELLS} SELECT {', '.join(_cell_columns)} FROM cells"

ORACLES: dict[str, str] = {
    "bronze_envelope": f"WITH {LINES} SELECT row, value, strftime(arrived, '{TIME_FORM}') AS arrived FROM lines",
    "ndjson_intake": f"""WITH {LINES}, faulty AS (
        SELECT row, arrived, CASE WHEN (row - 1) % 101 = 0 THEN '' WHEN (row - 1) % 103 = 0
          THEN substr(value, 1, 40) WHEN (row - 1) % 107 = 0 THEN value || ' x' ELSE value END AS value FROM lines)
      SELECT row, strftime(arrived, '{TIME_FORM}') AS arrived, length(value)::int AS n_chars,
        CASE WHEN json_valid(value) THEN 'accepted' ELSE 'rejected' END AS status,
        CASE WHEN json_valid(value) THEN json_extract_string(value, '$.doctor_id') END AS doctor_id
      FROM faulty WHERE value <> ''""",
    "ndjson_stream_to_bronze": f"""WITH {LINES}, faulty AS (
        SELECT row, CASE WHEN (row - 1) % 101 = 0 THEN '' WHEN (row - 1) % 103 = 0
          THEN substr(value, 1, 40) WHEN (row - 1) % 107 = 0 THEN value || ' x' ELSE value END AS value FROM lines)
      SELECT CASE WHEN json_valid(value) THEN 'accepted' ELSE 'rejected' END AS status,
        CASE WHEN json_valid(value) THEN row END AS row,
        CASE WHEN NOT json_valid(value) THEN value END AS line
      FROM faulty WHERE value <> ''""",
    "overlap_replay": f"WITH {CELLS} SELECT row, {stamp('arrived')} AS timestamp_bronze FROM sent",
    "csv_batch_envelopes": f"WITH {CELLS} SELECT {', '.join(_cell_columns)}, true AS own_place FROM cells",
    "csv_multiline": f"""WITH {CELLS} SELECT {', '.join(_cell_columns)}, true AS own_place FROM (
        SELECT * REPLACE (CASE WHEN row % 2 = 0 THEN patient_last_name ELSE {_broken} END AS patient_last_name) FROM cells)""",
    "csv_records_across_splits": f"""WITH {CELLS} SELECT {', '.join(_cell_columns)}, true AS own_place,
        row_number() OVER (ORDER BY row) AS number FROM (SELECT * REPLACE ({_broken} AS patient_last_name) FROM cells)""",
    "csv_resume_rows": f"""{_cells} UNION ALL SELECT {', '.join(_cell_columns)} FROM (
        SELECT *, row_number() OVER (ORDER BY row) AS number FROM cells) WHERE number > 445 AND number <= 450""",
    "csv_listing": "SELECT count(*)::bigint AS n_rows, 0::bigint AS n_missed FROM events",
    "csv_two_sources": _cells,
    "csv_row_numbers": """SELECT count(*) AS n_rows, count(*) AS n_places, 0::bigint AS n_gaps FROM events""",
    "csv_stream_to_bronze": _cells,
    "csv_resume": _cells,
    "csv_reset": f"{_cells} UNION ALL SELECT {', '.join(_cell_columns)} FROM cells",
    "jdbc_style_doctor_scan": f"WITH {DOCTORS_RAW} SELECT * FROM doctors_raw",
    "patient_fields": f"WITH {TEXTS} SELECT {', '.join(KEYS)}, timestamp_bronze FROM texts",
    "null_sentinels": f"WITH {MARKED} SELECT {', '.join(KEYS)}, timestamp_bronze FROM marked",
    "gender_norm": clean_of("gender"),
    "admission_flag": clean_of("admission_flag"),
    "text_norm": clean_of("first_initial", "last_name", "race", "department_referral"),
    "numeric_coerce": clean_of("age", "satisfaction_score", "wait_time"),
    "bool_coerce": clean_of("coordinator_manager_flag"),
    "int_coerce": f"WITH {TEXTS} SELECT source_row AS raw_source_row, source_row::int AS source_row FROM texts",
    "multi_format_ts": clean_of("admission_datetime"),
    "visit_key": f"WITH {CLEAN} SELECT patient_id, {at('admission_datetime')}, visit_id FROM clean",
    "bronze_time": f"WITH {TEXTS} SELECT timestamp_bronze, strftime(arrived, '{TIME_FORM}') AS bronze_timestamp FROM texts",
    "patient_silver": f"WITH {CLEAN} SELECT {_visit_list} FROM clean",
    "doctor_silver": f"WITH {DOCTORS} SELECT {_doctor_list} FROM doctors_clean",
    "expect_drop_patient": f"WITH {CLEAN} SELECT {_visit_list} FROM kept",
    "expect_drop_doctor": f"WITH {DOCTORS} SELECT {_doctor_list} FROM doctors",
    "rule_report_patient": f"WITH {CLEAN} {report(VISIT_RULES, 'clean')}",
    "observed_rules_patient": f"SELECT rule, failed FROM (WITH {CLEAN} {report(VISIT_RULES, 'clean')})",
    "quarantine_rows": f"WITH {CLEAN} SELECT source_row, visit_id FROM kept WHERE source_row % 17 = 0",
    "rule_report_doctor": f"WITH {DOCTORS} {report(DOCTOR_RULES, 'doctors_clean')}",
    "violations_patient": f"""WITH {CLEAN} {failing(VISIT_RULES, "clean",
        "source_row, age, satisfaction_score, wait_time, doctor_id, visit_id")}""",
    "violations_doctor": f"WITH {DOCTORS} {failing(DOCTOR_RULES, 'doctors_clean', _doctor_list)}",
    "scd1_current": f"WITH {VISITS} SELECT {_visit_list} FROM visits",
    "scd1_stream": f"WITH {VISITS} SELECT {_visit_list} FROM visits",
    "scd1_changes": f"""WITH {VISITS}, early_kept AS (SELECT * FROM kept WHERE bronze_timestamp < '2024-01-16'),
      {current('early', 'early_kept')}, gone AS (SELECT * FROM early EXCEPT SELECT * FROM visits),
      came AS (SELECT * FROM visits EXCEPT SELECT * FROM early)
      SELECT 'update_preimage' AS change, {_visit_list} FROM gone
      UNION ALL SELECT CASE WHEN visit_id IN (SELECT visit_id FROM early) THEN 'update_postimage' ELSE 'insert' END, {_visit_list} FROM came""",
    "visits_enriched": f"WITH {GOLD} SELECT {GOLD_COLUMNS} FROM gold",
    "visits_enriched_salted": f"WITH {GOLD} SELECT {GOLD_COLUMNS} FROM gold",
    "age_bands": f"WITH {GOLD} SELECT age, age_group, count(*) AS visits FROM gold GROUP BY age, age_group",
    "wait_bands": f"""WITH {GOLD} SELECT wait_time, wait_bucket_in_mins, count(*) AS visits
      FROM gold GROUP BY wait_time, wait_bucket_in_mins""",
    "experience_bands": f"""WITH {GOLD} SELECT years_of_experience, experience_bucket_in_years,
      count(*) AS visits FROM gold GROUP BY years_of_experience, experience_bucket_in_years""",
    "calendar_columns": f"""WITH {GOLD} SELECT visit_id, {at('admission_datetime')},
      admission_month::varchar AS admission_month, admission_hour, weekday_num, weekday FROM gold""",
    "wait_vs_satisfaction": f"""WITH {GOLD} SELECT wait_bucket_in_mins, {measures("visits",
        "avg_satisfaction", "satisfaction_responses", "admission_rate_pct")}
      FROM gold GROUP BY wait_bucket_in_mins""",
    "department_monthly_stats": f"""WITH {ROLLED} SELECT * REPLACE (admission_month::varchar AS admission_month)
      FROM monthly""",
    "doctor_performance": f"WITH {ROLLED} SELECT * FROM performance",
    "coordinator_impact": f"""WITH {GOLD} SELECT age_group, CASE WHEN coordinator_involved = 1
        THEN 'with_coordinator' ELSE 'without_coordinator' END AS coordinator,
        {measures("visits", "avg_wait_time", "avg_satisfaction", "admission_rate_pct")}
      FROM gold GROUP BY 1, 2""",
    "wait_time_by_hour_weekday": f"WITH {ROLLED} SELECT * FROM by_hour",
    "masked_admin": secured_visits(True, []),
    "masked_clerk": secured_visits(False, ["dept_cardiology"]),
    "dept_filter_none": secured_visits(False, []),
    "dept_filter_one": f"""WITH {GOLD} SELECT {GOLD_COLUMNS} FROM gold
      WHERE {visible("department_referral", ["dept_cardiology"])}""",
    "dept_filter_groups": f"""WITH {ROLLED} SELECT * REPLACE (admission_month::varchar AS admission_month)
      FROM monthly WHERE {visible("department_referral", ["dept_cardiology", "dept_no_referral"])}""",
    "dept_filter_members": f"""WITH {VISITS}, members AS (
        SELECT n_name AS reader, {pick("n_nationkey", *texts(*_groups))} AS grp FROM nation
        UNION SELECT n_name, CASE WHEN n_nationkey % 9 = 8 THEN 'hospital_admin' ELSE 'dept_cardiology' END FROM nation),
      readers AS (SELECT reader, list(grp) AS groups, list_contains(list(grp), 'hospital_admin') AS admin FROM members GROUP BY reader)
      SELECT reader, visit_id, CASE WHEN admin THEN last_name ELSE '***' END AS last_name, department_referral
      FROM readers JOIN visits ON admin OR list_contains(groups, 'dept_' || lower(replace(department_referral, ' ', '_')))""",
    "access_functions": f"""WITH {VISITS} SELECT visit_id, '***' AS last_name, department_referral
      FROM visits WHERE {visible("department_referral", ["dept_general_practice", "dept_neurology"])}""",
    "gold_no_pii": f"WITH {GOLD} SELECT {GOLD_COLUMNS} FROM gold",
    "corpus_dept": f"WITH {ROLLED} {department_docs('monthly')}",
    "corpus_doctor": f"WITH {ROLLED} {doctor_docs('performance')}",
    "corpus_union": f"WITH {DOCS} SELECT * FROM docs",
    "lake_corpus": f"WITH {DOCS} SELECT doc_id, text, department, period, doc_type FROM docs",
    "corpus_changes": f"WITH {EARLIER} SELECT doc_id, op, text, department, period, doc_type FROM feed WHERE op <> 'unchanged'",
    "corpus_operations": f"WITH {EARLIER} SELECT op, count(*) AS documents FROM feed GROUP BY op",
    "corpus_merged": f"WITH {EARLIER} SELECT doc_id, text, department, period, doc_type FROM docs",
    "corpus_apply": f"WITH {EARLIER} SELECT doc_id, text, department, period, doc_type FROM docs",
    "embed_changed": f"""WITH {EARLIER}, {CRC}, written AS (SELECT * FROM feed WHERE op IN ('insert', 'update')),
      {word_vectors("v", "written", "doc_id", "text")}
      SELECT v.id AS doc_id, op, slot::int AS slot, round(weight::double, 6) AS weight
      FROM v JOIN feed ON feed.doc_id = v.id""",
    "vector_refresh": f"""WITH {DOCS}, {CRC}, {word_vectors("v", "docs", "doc_id", "text")}
      SELECT id AS doc_id, slot::int AS slot, round(weight::double, 6) AS weight FROM v""",
    "topk_retrieval": """WITH parts AS (
        SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
      ), means AS (SELECT label, i, avg(x::double)::float AS x FROM parts GROUP BY label, i
      ), questions AS (SELECT label, list(x::double ORDER BY i) AS q FROM means GROUP BY label
      ), scored AS (SELECT label AS question_id, vec_id AS doc_id,
          round(list_cosine_similarity(q, embedding::double[]), 12) AS score
        FROM questions CROSS JOIN (SELECT vec_id, embedding FROM embeddings))
      SELECT question_id, rank, doc_id, round(score, 6) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id)::int AS rank
        FROM scored) WHERE rank <= 6""",
    "document_retrieval": f"""WITH {CRC}, {word_vectors("q", "benchmark", "item_id", "text")},
      {word_vectors("d", "documents", "doc_id", "text")},
      qn AS (SELECT id, sqrt(sum(weight::double * weight::double)) AS norm FROM q GROUP BY id),
      dn AS (SELECT id, sqrt(sum(weight::double * weight::double)) AS norm FROM d GROUP BY id),
      dots AS (SELECT q.id AS question_id, d.id AS doc_id, sum(q.weight::double * d.weight::double) AS dot
        FROM q JOIN d ON q.slot = d.slot GROUP BY q.id, d.id),
      scored AS (SELECT item_id AS question_id, documents.doc_id,
          round(coalesce(dot / (qn.norm * dn.norm), 0), 12) AS score
        FROM benchmark CROSS JOIN documents
        LEFT JOIN dots ON dots.question_id = item_id AND dots.doc_id = documents.doc_id
        LEFT JOIN qn ON qn.id = item_id LEFT JOIN dn ON dn.id = documents.doc_id)
      SELECT question_id, rank, doc_id, round(score, 6) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id)::int AS rank
        FROM scored) WHERE rank <= 6""",
    "insight_retrieval": f"WITH {RETRIEVED} SELECT question_id, rank, doc_id, text, round(score, 6) AS score FROM found",
    "context_lines": f"WITH {RETRIEVED} SELECT question_id, context FROM contexts",
    "prompt_rows": f"""WITH {RETRIEVED} SELECT q.question_id,
        'You are an assistant for emergency room operations. Answer ONLY from the provided context. '
        || 'If the context does not contain the answer, say you don''t know. '
        || 'Cite the doc_ids you used in square brackets, e.g. [dept-Orthopedics-2024-01].' AS system,
        'Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || question AS prompt
      FROM questions q LEFT JOIN contexts c ON q.question_id = c.question_id""",
    "bi_department_totals": f"""WITH {ROLLED} SELECT department_referral,
        {rounded("avg(admission_rate_pct::decimal(20,4))", 2)} AS total_admission_rate,
        {rounded("avg(avg_satisfaction::decimal(20,4))", 2)} AS total_satisfaction
      FROM monthly GROUP BY department_referral""",
    "bi_satisfaction": f"""WITH {ROLLED} SELECT department_referral,
        {rounded("avg(avg_satisfaction::decimal(20,4))", 2)} AS total_satisfaction
      FROM monthly GROUP BY department_referral""",
    "bi_admission_rate": f"""WITH {ROLLED} SELECT department_referral,
        {rounded("avg(admission_rate_pct::decimal(20,4))", 2)} AS sum_total_admission_rate
      FROM monthly GROUP BY department_referral""",
    "bi_department_wait": f"""WITH {GOLD} SELECT department, admission_month::varchar AS admission_month, wait_time
      FROM gold WHERE department IN ('Cardiology', 'Emergency Medicine', 'Neurology', 'Physiotherapy',
        'Gastroenterology', 'General Practice', 'Orthopedics')""",
    "bi_department_wait_avg": f"""WITH {GOLD} SELECT department, admission_month::varchar AS admission_month,
        {rounded("avg(wait_time)", 1)} AS avg_wait_time
      FROM gold WHERE department IN ('Cardiology', 'Emergency Medicine', 'Neurology', 'Physiotherapy',
        'Gastroenterology', 'General Practice', 'Orthopedics') GROUP BY department, admission_month""",
    "bi_visits_per_month": f"""WITH {ROLLED} SELECT strftime(date_trunc('month', admission_month)::timestamp,
        '{TIME_FORM}') AS month, sum(visits)::bigint AS sum_visits FROM monthly GROUP BY 1""",
    "bi_wait_heatmap": f"""WITH {ROLLED} SELECT weekday_num, admission_hour, sum(avg_wait_time) AS sum_avg_wait_time
      FROM by_hour GROUP BY weekday_num, admission_hour""",
    "bi_doctor_board": f"""WITH {ROLLED} SELECT doctor_first_name, doctor_last_name, subspecialty, avg_wait_time,
        avg_satisfaction, admission_rate_pct, years_of_experience FROM performance""",
    **{
        f"bi_wait_{name.lower().replace(' ', '_')}": f"""WITH {GOLD}
      SELECT admission_month::varchar AS admission_month, wait_time FROM gold WHERE department = '{name}'"""
        for name in ("Cardiology", "Emergency Medicine", "Neurology", "Physiotherapy",
                     "Gastroenterology", "General Practice", "Orthopedics")
    },
}
ORACLES["gold_refreshed"] = ORACLES["visits_enriched"]
ORACLES |= {f"refreshed_{name}": ORACLES[name] for name in (
    "wait_vs_satisfaction", "department_monthly_stats", "doctor_performance", "coordinator_impact", "wait_time_by_hour_weekday",
)}
ORACLES["topk_indexed"] = ORACLES["topk_retrieval"]
ORACLES["document_retrieval_indexed"] = ORACLES["document_retrieval"]
