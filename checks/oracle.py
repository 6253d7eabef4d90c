"""The queries of `checks.queries` as SQL for DuckDB, written with joins and set operations where Spark uses month sets."""

from __future__ import annotations

from checks import fixtures as fx
from checks import lists
from checks.expected import BASES, CATEGORIES, CLASSES, COMPLETENESS, MEASURES, UNKNOWN
from tallyhouse.schemas import PERSON, PERSON_FIELDS, SERVICES

AS_OF = f"DATE '{fx.AS_OF}'"
START, END = "DATE '2000-07-01'", "DATE '2001-07-01'"
IDS = ("pantry_client_id", "pharmacy_pat_key", "clinic_patientid")


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def pick(values: tuple[str | None, ...], number: str) -> str:
    items = ", ".join(text(v) for v in values)
    return f"([{items}])[CAST(({number}) % {len(values)} + 1 AS INTEGER)]"


def birth_date(key: str) -> str:
    return f"CASE WHEN {key} % 19 <> 0 THEN DATE '1930-01-01' + CAST((({key} // 3) * 7919) % 400 * 72 AS INTEGER) END"


def parsed(c: str) -> str:
    """Date of export text."""
    t = f"trim({c})"
    y, m, d = (f"split_part({t}, '/', {n})" for n in (3, 1, 2))
    year = f"CASE length({y}) WHEN 4 THEN {y} WHEN 2 THEN (CASE WHEN {y} >= '70' THEN '19' ELSE '20' END) || {y} END"
    return (
        f"CASE WHEN regexp_matches({t}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST(substr({t}, 1, 10) AS DATE) "
        f"WHEN regexp_matches({t}, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}$') "
        f"THEN TRY_CAST(({year}) || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE) END"
    )


def number(c: str) -> str:
    return f"CASE WHEN regexp_matches(trim({c}), '^[0-9]+$') THEN CAST(TRY_CAST(trim({c}) AS UBIGINT) AS DECIMAL(20, 0)) END"


def blank(c: str) -> str:
    return f"({c} IS NULL OR trim({c}) = '')"


def person_cte() -> str:
    ids = ", ".join(
        f"CASE WHEN c_custkey % {fx.NULL_EVERY[s.service]} <> 0 THEN c_custkey + {fx.ID_BASE[s.service]} END AS {s.person_key}"
        for s in SERVICES
    )
    facts = ", ".join(
        f"{pick(values, f'c_custkey * {factor}')} AS {name}" for name, (values, factor) in lists.DEMOGRAPHICS.items()
    )
    return (
        f"person AS (SELECT c_custkey AS person_id, {ids}, {pick(lists.FIRST_NAMES, 'c_custkey')} AS first_name, "
        f"{pick(lists.LAST_NAMES, 'c_custkey // 5')} AS last_name, {birth_date('c_custkey')} AS dob, {facts} FROM customer)"
    )


HOUSEHOLD = "household AS (SELECT c_custkey // 3 AS household_id, c_custkey AS person_id FROM customer WHERE c_custkey % 7 <> 0)"

DATE_TEXT = """CASE o_orderkey % 10
 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d 10:15:00')
 WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT09:00:00Z')
 WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y')
 WHEN 3 THEN strftime(o_orderdate, '%-m/%-d/%y')
 WHEN 4 THEN '  ' || strftime(o_orderdate, '%Y-%m-%d') || ' '
 WHEN 5 THEN ''
 WHEN 6 THEN strftime(o_orderdate, '%m/%d/%Y') || ' 10:15'
 WHEN 7 THEN 'n/a'
 ELSE strftime(o_orderdate, '%Y-%m-%d') END"""


def exports_cte(merge: bool = False) -> str:
    base = "CASE o_orderkey % 3 " + " ".join(f"WHEN {d} THEN {fx.ID_BASE[s]}" for s, d in fx.SERVICE_DIGIT.items()) + " END"
    service = "CASE o_orderkey % 3 " + " ".join(f"WHEN {d} THEN '{s}'" for s, d in fx.SERVICE_DIGIT.items()) + " END"
    extra = ""
    if merge:
        facts = [
            f"{pick(lists.FIRST_NAMES, 'o_custkey')} AS first_name",
            f"{pick(lists.LAST_NAMES, 'o_custkey // 5')} AS last_name",
            f"CASE WHEN o_orderkey % 4 <> 0 THEN CAST({birth_date('o_custkey')} AS VARCHAR) ELSE '' END AS dob",
        ]
        facts += [
            f"{pick(values, f'o_custkey * {factor} + o_orderkey % 3 + o_orderkey % 5')} AS {name}"
            for name, (values, factor) in lists.DEMOGRAPHICS.items()
        ]
        facts.append("CASE WHEN o_orderkey % 13 <> 0 THEN ' ' || (o_custkey // 3) ELSE '' END AS household_text")
        extra = ", " + ", ".join(facts)
    return (
        f"raw AS (SELECT {service} AS service, CASE WHEN o_orderkey % 17 <> 0 THEN ' 00' || (o_custkey + {base}) || ' ' "
        "WHEN (o_orderkey // 17) % 4 = 0 THEN 'X' || o_custkey WHEN (o_orderkey // 17) % 4 = 1 THEN '123456789012345678901234' "
        "WHEN (o_orderkey // 17) % 4 = 2 THEN '  ' ELSE CAST(18446744073709551615 - o_custkey AS VARCHAR) END AS id_text, " + f"{DATE_TEXT} AS date_text{extra} FROM orders)"
    )


KEYS = "person_keys AS (" + " UNION ALL ".join(
    f"SELECT '{s.service}' AS service, {s.person_key} AS key, person_id FROM person WHERE {s.person_key} IS NOT NULL"
    for s in SERVICES
) + ")"
EVENTS = (
    f"ev AS (SELECT DISTINCT service, person_id, CAST(date_trunc('month', d) AS DATE) AS month FROM "
    f"(SELECT service, {number('id_text')} AS key, {parsed('date_text')} AS d FROM raw) x JOIN person_keys USING (service, key) "
    f"WHERE d >= {START} AND d < {END})"
)
SERVED = (
    "served AS (SELECT DISTINCT other.person_id, ev.month FROM ev JOIN household h ON h.person_id = ev.person_id "
    "JOIN household other ON other.household_id = h.household_id WHERE ev.service = 'pantry' "
    "UNION SELECT person_id, month FROM ev WHERE service = 'pantry')"
)
USES = {
    "pantry": "SELECT {c} FROM ev WHERE service = 'pantry'",
    "pharmacy": "SELECT {c} FROM ev WHERE service = 'pharmacy'",
    "clinic": "SELECT {c} FROM ev WHERE service = 'clinic'",
    "pantry_served": "SELECT {c} FROM served",
}


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def window_start(months: int) -> str:
    """First day of a window that ends with the month before END."""
    return f"CAST({END} - to_months({months}) AS DATE)"


def usage_ctes(months: int = 12) -> list[str]:
    return [person_cte(), HOUSEHOLD, exports_cte(), KEYS, EVENTS.replace(START, window_start(months)), SERVED]


def measure_rows(columns: str) -> str:
    """(m, …) for every measure: the uses it needs, intersected."""
    parts = []
    for name, flags in MEASURES.items():
        together = " INTERSECT ".join("(" + USES[f].format(c=f"DISTINCT {columns}") + ")" for f in flags)
        parts.append(f"SELECT '{name}' AS m, * FROM ({together}) t")
    return " UNION ALL ".join(parts)


def counted(names: list[str]) -> str:
    return ", ".join(f"count(*) FILTER (WHERE m = '{n}') AS {n}" for n in names)


def monthly(names: list[str]) -> str:
    return f"SELECT month, {counted(names)} FROM ({measure_rows('person_id, month')}) u GROUP BY month"


def annual(names: list[str]) -> str:
    return f"SELECT {counted(names)} FROM ({measure_rows('person_id')}) u"


def usage_report(months: int = 12) -> str:
    names = list(MEASURES)
    zero = ", ".join(f"coalesce({n}, 0) AS {n}" for n in names)
    spine = f"SELECT CAST({window_start(months)} + to_months(CAST(i AS INTEGER)) AS DATE) AS month FROM range({months}) r(i)"
    rows = (
        f"SELECT strftime(s.month, '%Y-%m') AS period, {zero} FROM ({spine}) s LEFT JOIN ({monthly(names)}) c ON c.month = s.month "
        f"UNION ALL SELECT 'ANNUAL' AS period, {', '.join(names)} FROM ({annual(names)}) y"
    )
    pct = ", ".join(
        f"CASE WHEN {b} > 0 THEN CAST({n} AS DOUBLE) * 100 / {b} ELSE 0.0::DOUBLE END AS {n}_pct" for n, b in BASES.items()
    )
    return f"SELECT *, {pct} FROM ({rows}) r"


def usage_columns() -> list[str]:
    out = ["period"]
    for n in MEASURES:
        out += [n, f"{n}_pct"] if n in BASES else [n]
    return out


def plain(c: str) -> str:
    return f"regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '')"


def quoted(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '[\",\\n\\r]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"


def age(c: str) -> str:
    years = (
        f"(year({AS_OF}) - year({c}) - CASE WHEN month({AS_OF}) * 100 + day({AS_OF}) < month({c}) * 100 + day({c}) "
        "THEN 1 ELSE 0 END)"
    )
    return (
        f"CASE WHEN {c} IS NULL THEN 'Unknown/Blank' WHEN {c} > {AS_OF} THEN 'Invalid (DOB in future)' "
        f"WHEN {years} < 18 THEN 'Under 18' WHEN {years} <= 64 THEN '18-64' ELSE '65+' END"
    )


def category(name: str) -> str:
    kind, c = CATEGORIES[name]
    if kind == "age":
        value = age(c)
    elif kind == "classes":
        told = ", ".join(f"{text(v)}: {text(k)}" for v, k in CLASSES[c].items())
        value = f"CASE WHEN {c} IS NULL THEN '{UNKNOWN}' ELSE MAP {{{told}}}[{c}] END"
    else:
        value = f"coalesce(nullif(trim({c}), ''), 'Unknown/Blank')"
    return f'SELECT \'{name}\' AS category, {value} AS value, count(*) AS "count" FROM person GROUP BY ALL'


def completeness() -> str:
    return " UNION ALL ".join(
        f"SELECT '{label}' AS value, count(*) FILTER (WHERE {c + ' IS NULL' if c == 'dob' else blank(c)}) AS \"count\" FROM person"
        for label, c in COMPLETENESS.items()
    )


def profile() -> str:
    rows = " UNION ALL ".join(category(n) for n in CATEGORIES)
    rows += f" UNION ALL SELECT 'data_quality' AS category, value, \"count\" FROM ({completeness()}) q"
    return (
        'SELECT category, value, "count", floor(CAST("count" AS DOUBLE) * 10000 / total + 0.5) / 100.0::DOUBLE '
        f"AS percent_of_total_persons FROM ({rows}) r, (SELECT count(*) AS total FROM person) t"
    )


def raw_values() -> str:
    return " UNION ALL ".join(category(n) for n, (kind, _) in CATEGORIES.items() if kind == "raw")


SOUND_CODES = "01230127022455012623017202"


def soundex(c: str) -> str:
    """Letters to digits; h and w are passed over, equal neighbours count once, other characters part them."""
    plain_text = f"translate(upper(trim({c})), 'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ', 'AAAAAACEEEEIIIINOOOOOOUUUUY')"
    codes = (
        f"list_transform(string_split({plain_text}, ''), lambda x: CASE WHEN x BETWEEN 'A' AND 'Z' "
        f"THEN substr('{SOUND_CODES}', ascii(x) - 64, 1) ELSE '0' END)"
    )
    kept = f"list_concat([({codes})[1]], list_filter(({codes})[2:], lambda x: x <> '7'))"
    digits = (
        f"array_to_string(list_transform(list_filter(range(2, len({kept}) + 1), "
        f"lambda i: ({kept})[i] <> '0' AND ({kept})[i] <> ({kept})[i - 1]), lambda i: ({kept})[i]), '')"
    )
    return f"substr(substr({plain_text}, 1, 1) || {digits} || '000', 1, 4)"


def names(same_dob: bool, sound: bool) -> str:
    dob = ", dob" if same_dob else ""
    where = f"NOT {blank('first_name')} AND NOT {blank('last_name')}" + (" AND dob IS NOT NULL" if same_dob else "")
    sounds = f", {soundex('first')} AS sf, {soundex('last')} AS sl" if sound else ""
    return (
        f"names AS (SELECT *{sounds} FROM (SELECT lower(trim(first_name)) AS first, lower(trim(last_name)) AS last{dob}, "
        f"count(*) AS n, min(person_id) AS low_id, max(person_id) AS high_id FROM person WHERE {where} GROUP BY ALL) g)"
    )


def similar(same_dob: bool, sound: bool, ratio: float) -> str:
    on = "(a.last, a.first) < (b.last, b.first)"
    on += " AND a.dob = b.dob" if same_dob else ""
    on += " AND a.sf = b.sf AND a.sl = b.sl" if sound else ""
    # This levenshtein counts bytes: letters of two bytes are first swapped for digits, which no name holds.
    def one_byte(c: str) -> str:
        return f"translate({c}, 'éñú', '123')"

    rf, rl = (
        f"(1 - CAST(levenshtein({one_byte('a.' + f)}, {one_byte('b.' + f)}) AS DOUBLE) / greatest(length(a.{f}), length(b.{f})))"
        for f in ("first", "last")
    )
    dob = "a.dob, " if same_dob else ""
    return with_ctes(person_cte(), names(same_dob, sound)) + (
        f"SELECT {dob}a.first AS first_name_a, a.last AS last_name_a, b.first AS first_name_b, b.last AS last_name_b, "
        f"a.low_id AS person_id_a, b.low_id AS person_id_b, a.n * b.n AS person_pairs, {rf} AS ratio_first, {rl} AS ratio_last "
        f"FROM names a JOIN names b ON {on} WHERE {rf} >= {ratio}::DOUBLE AND {rl} >= {ratio}::DOUBLE "
        f"UNION ALL SELECT {dob}first, last, first, last, low_id, high_id, n * (n - 1) // 2, 1.0::DOUBLE, 1.0::DOUBLE "
        "FROM names a WHERE n > 1"
    )


def multi_dob() -> str:
    return with_ctes(
        person_cte(),
        "named AS (SELECT *, lower(trim(first_name)) AS f, lower(trim(last_name)) AS l FROM person "
        f"WHERE NOT {blank('first_name')} AND NOT {blank('last_name')})",
        "many AS (SELECT f, l, count(DISTINCT dob) AS dob_count FROM named GROUP BY f, l HAVING count(DISTINCT dob) > 1)",
    ) + "SELECT named.* EXCLUDE (f, l), dob_count FROM named JOIN many USING (f, l)"


def records_ctes() -> list[str]:
    fields = ", ".join(
        f"{parsed('dob')} AS dob" if f == "dob" else f"nullif(trim({f}), '') AS {f}" for f in PERSON_FIELDS
    )
    typed = (
        f"typed AS (SELECT service, {number('id_text')} AS key, coalesce({parsed('date_text')}, DATE '0001-01-01') AS seen, "
        f"{fields}, household_text FROM raw)"
    )
    latest = ", ".join(f"max({{'s': seen, 'v': {f}}}) FILTER (WHERE {f} IS NOT NULL) AS {f}" for f in PERSON_FIELDS)
    records = f"records AS (SELECT service, key, {latest} FROM typed WHERE key IS NOT NULL GROUP BY service, key)"
    over = ", ".join(
        f"max({{'s': r.{f}.s, 'w': service, 'v': r.{f}.v}}) FILTER (WHERE r.{f} IS NOT NULL) AS {f}" for f in PERSON_FIELDS
    )
    return [
        exports_cte(merge=True),
        typed,
        records,
        f"best AS (SELECT person_id, {over} FROM person_keys JOIN records r USING (service, key) GROUP BY person_id)",
    ]


def merge_ctes() -> list[str]:
    return [person_cte(), HOUSEHOLD, KEYS, *records_ctes(), f"fresh AS ({FRESH})"]


NEW_ID = "CAST(-(CAST(key AS DECIMAL(30, 0)) * 4 + CASE service WHEN 'pantry' THEN 0 WHEN 'pharmacy' THEN 1 ELSE 2 END + 1) AS DECIMAL(20, 0))"
FRESH = (
    "SELECT r.* FROM records r WHERE NOT EXISTS (SELECT 1 FROM person_keys k WHERE k.service = r.service AND k.key = r.key)"
)


def inserted(source: str) -> str:
    ids = ", ".join(f"CASE WHEN service = '{s.service}' THEN key END AS {s.person_key}" for s in SERVICES)
    return f"SELECT {NEW_ID} AS person_id, {ids}, {', '.join(f'{f}.v AS {f}' for f in PERSON_FIELDS)} FROM {source} r"


def rebuilt_ctes() -> list[str]:
    """`person` from the records alone: ids of one name and birth date together, where no service has two of them."""
    counts = ", ".join(f"count(*) FILTER (WHERE service = '{s.service}') AS n_{s.service}" for s in SERVICES)
    keys = ", ".join(f"CAST(max(key) FILTER (WHERE service = '{s.service}') AS DECIMAL(20, 0)) AS {s.person_key}" for s in SERVICES)
    facts = ", ".join(
        f"(max({{'s': {f}.s, 'w': service, 'v': {f}.v}}) FILTER (WHERE {f} IS NOT NULL)).v AS {f}" for f in PERSON_FIELDS
    )
    least = "CASE WHEN pantry_client_id IS NOT NULL THEN pantry_client_id * 4 + 1 " + (
        "WHEN pharmacy_pat_key IS NOT NULL THEN pharmacy_pat_key * 4 + 2 ELSE clinic_patientid * 4 + 3 END"
    )
    for i in IDS:
        least = least.replace(f"THEN {i}", f"THEN CAST({i} AS DECIMAL(30, 0))").replace(f"ELSE {i}", f"ELSE CAST({i} AS DECIMAL(30, 0))")
    return [
        "named AS (SELECT *, lower(trim(first_name.v)) AS nf, lower(trim(last_name.v)) AS nl, dob.v AS nd FROM records)",
        f"groups AS (SELECT nf, nl, nd, {counts} FROM named WHERE nf <> '' AND nl <> '' AND nd IS NOT NULL GROUP BY nf, nl, nd)",
        "together AS (SELECT nf, nl, nd, true AS one FROM groups WHERE n_pantry <= 1 AND n_pharmacy <= 1 AND n_clinic <= 1)",
        "owned AS (SELECT n.*, CASE WHEN one THEN nf || '|' || nl || '|' || CAST(nd AS VARCHAR) ELSE service || ':' || CAST(key AS VARCHAR) END "
        "AS who FROM named n LEFT JOIN together USING (nf, nl, nd))",
        f"people AS (SELECT {keys}, {facts} FROM owned GROUP BY who)",
        f"person AS (SELECT CAST(-({least}) AS DECIMAL(20, 0)) AS person_id, * FROM people)",
    ]


def linked_ctes() -> list[str]:
    """Components of names and people, by walking from name to name; then who gets which new id, and who is new."""
    name = "struct_pack(f := lower(trim({f})), l := lower(trim({l})), d := {d})"
    whole = "lower(trim({f})) <> '' AND lower(trim({l})) <> '' AND {d} IS NOT NULL"
    own = {"f": "first_name", "l": "last_name", "d": "dob"}
    given = {"f": "r.first_name.v", "l": "r.last_name.v", "d": "r.dob.v"}
    counts = " AND ".join(f"count(*) FILTER (WHERE service = '{s.service}') <= 1" for s in SERVICES)
    added = ", ".join(f"max(key) FILTER (WHERE service = '{s.service}') AS new_{s.person_key}" for s in SERVICES)
    ids = ", ".join(
        f"coalesce(CAST(p.{s.person_key} AS DECIMAL(20, 0)), CAST(a.new_{s.person_key} AS DECIMAL(20, 0))) AS {s.person_key}" for s in SERVICES
    )
    facts = ", ".join(f"p.{f}" for f in PERSON_FIELDS)
    keys = " UNION ALL ".join(
        f"SELECT '{s.service}' AS service, {s.person_key} AS key, person_id FROM joined WHERE {s.person_key} IS NOT NULL" for s in SERVICES
    )
    over = ", ".join(
        f"max({{'s': r.{f}.s, 'w': service, 'v': r.{f}.v}}) FILTER (WHERE r.{f} IS NOT NULL) AS {f}" for f in PERSON_FIELDS
    )
    return [
        person_cte(),
        HOUSEHOLD,
        KEYS,
        *records_ctes()[:3],
        f"known AS (SELECT person_id, {name.format(**own)} AS name FROM person WHERE {whole.format(**own)} UNION "
        f"SELECT person_id, {name.format(**given)} FROM person_keys JOIN records r USING (service, key) WHERE {whole.format(**given)})",
        f"fresh0 AS (SELECT service, key, {name.format(**given)} AS name FROM ({FRESH}) r WHERE {whole.format(**given)})",
        "walk(name, root) AS (SELECT name, name FROM (SELECT name FROM known UNION SELECT name FROM fresh0) n "
        "UNION SELECT other.name, w.root FROM walk w JOIN known mine ON mine.name = w.name JOIN known other ON other.person_id = mine.person_id)",
        "roots AS (SELECT name, min(root) AS root FROM walk GROUP BY name)",
        "wanted AS (SELECT service, key, root FROM fresh0 JOIN roots USING (name))",
        "near AS (SELECT DISTINCT root, person_id FROM known JOIN roots USING (name) WHERE root IN (SELECT root FROM wanted))",
        "held AS (SELECT root, service, key FROM wanted UNION ALL SELECT root, service, key FROM near JOIN person_keys USING (person_id))",
        f"clear AS (SELECT root FROM held GROUP BY root HAVING {counts})",
        "judged AS (SELECT root, count(*) AS people, max(person_id) AS person_id FROM near GROUP BY root)",
        "links AS (SELECT service, key, person_id FROM wanted JOIN judged USING (root) WHERE people = 1 AND root IN (SELECT root FROM clear))",
        "apart AS (SELECT service, key FROM wanted JOIN judged USING (root) EXCEPT SELECT service, key FROM links)",
        f"added AS (SELECT person_id, {added} FROM links GROUP BY person_id)",
        f"joined AS (SELECT p.person_id, {ids}, {facts} FROM person p LEFT JOIN added a USING (person_id))",
        f"joined_keys AS ({keys})",
        f"best AS (SELECT person_id, {over} FROM joined_keys JOIN records r USING (service, key) GROUP BY person_id)",
        "rest AS (SELECT r.* FROM records r WHERE NOT EXISTS (SELECT 1 FROM joined_keys k WHERE k.service = r.service AND k.key = r.key))",
        "alone AS (SELECT r.* FROM rest r JOIN apart USING (service, key))",
        "others AS (SELECT r.* FROM rest r WHERE NOT EXISTS (SELECT 1 FROM apart a WHERE a.service = r.service AND a.key = r.key))",
    ]


def linked_person() -> str:
    ids = ", ".join(f"CAST(p.{i} AS DECIMAL(20, 0)) AS {i}" for i in ("person_id", *IDS))
    facts = ", ".join(f"CASE WHEN {unset(f)} AND b.{f} IS NOT NULL THEN b.{f}.v ELSE p.{f} END AS {f}" for f in PERSON_FIELDS)
    by_name = [c.replace("FROM records)", "FROM others)").replace("person AS (", "new_people AS (") for c in rebuilt_ctes()]
    return with_ctes(*linked_ctes(), *by_name).replace("WITH ", "WITH RECURSIVE ", 1) + (
        f"SELECT {ids}, {facts} FROM joined p LEFT JOIN best b USING (person_id) UNION ALL {inserted('alone')} "
        f"UNION ALL SELECT person_id, {', '.join(IDS)}, {', '.join(PERSON_FIELDS)} FROM new_people"
    )


def linked_audit() -> str:
    column = "CASE service " + " ".join(f"WHEN '{s.service}' THEN '{s.person_key}'" for s in SERVICES) + " END"
    return with_ctes(*linked_ctes()).replace("WITH ", "WITH RECURSIVE ", 1) + (
        f"SELECT CAST(person_id AS DECIMAL(20, 0)) AS person_id, service AS source, 'update' AS action, {column} AS field, "
        "NULL::VARCHAR AS old_value, CAST(key AS VARCHAR) AS new_value FROM links"
    )


def unset(f: str) -> str:
    return f"p.{f} IS NULL" if f == "dob" else blank(f"p.{f}")


def merged_person() -> str:
    ids = ", ".join(f"CAST(p.{i} AS DECIMAL(20, 0)) AS {i}" for i in ("person_id", *IDS))
    facts = ", ".join(f"CASE WHEN {unset(f)} AND b.{f} IS NOT NULL THEN b.{f}.v ELSE p.{f} END AS {f}" for f in PERSON_FIELDS)
    return f"SELECT {ids}, {facts} FROM person p LEFT JOIN best b USING (person_id) UNION ALL {inserted('fresh')}"


def merged_audit() -> str:
    parts = [
        f"SELECT {NEW_ID} AS person_id, service AS source, 'insert' AS action, NULL::VARCHAR AS field, "
        "NULL::VARCHAR AS old_value, CAST(key AS VARCHAR) AS new_value FROM fresh"
    ]
    parts += [
        f"SELECT CAST(p.person_id AS DECIMAL(20, 0)), b.{f}.w, 'update', '{f}', CAST(p.{f} AS VARCHAR), CAST(b.{f}.v AS VARCHAR) "
        f"FROM person p JOIN best b USING (person_id) WHERE {unset(f)} AND b.{f} IS NOT NULL"
        for f in PERSON_FIELDS
    ]
    return " UNION ALL ".join(parts)


def swept() -> str:
    ids = ", ".join(f"CAST(p.{i} AS DECIMAL(20, 0)) AS {i}" for i in ("person_id", *IDS))
    facts = ", ".join(f"coalesce(b.{f}.v, p.{f}) AS {f}" for f in PERSON_FIELDS)
    return f"SELECT {ids}, {facts} FROM person p LEFT JOIN best b USING (person_id)"


def pantry_links(keyed: str) -> str:
    """Distinct household and person of usable pantry rows; `keyed` is the person id of a row."""
    return (
        f"SELECT DISTINCT {number('household_text')} AS household_id, {keyed} AS person_id FROM typed t "
        f"WHERE service = 'pantry' AND key IS NOT NULL AND {number('household_text')} IS NOT NULL"
    )


def all_sql() -> dict[str, str]:
    usage = with_ctes(*usage_ctes())
    people = with_ctes(person_cte())
    merges = with_ctes(*merge_ctes())
    texts = with_ctes(exports_cte())
    served = [m for m, flags in MEASURES.items() if len(flags) == 1]
    overlaps = [m for m, flags in MEASURES.items() if len(flags) > 1]
    header = usage_columns()
    usage_line = " || ',' || ".join(plain(c) if c.endswith("_pct") else f"CAST({c} AS VARCHAR)" for c in header)
    profile_line = (
        f"{quoted('category')} || ',' || {quoted('value')} || ',' || CAST(\"count\" AS VARCHAR) || ',' || "
        f"{plain('percent_of_total_persons')}"
    )
    reasons = (
        f"CASE WHEN {blank('id_text')} THEN 'blank id' WHEN NOT regexp_matches(trim(id_text), '^[0-9]+$') THEN 'id is not numeric' "
        f"WHEN ({number('id_text')}) IS NULL THEN 'id out of range' "
        f"WHEN {blank('date_text')} THEN 'blank date' WHEN ({parsed('date_text')}) IS NULL THEN 'date not understood' END"
    )
    sources = "CASE service " + " ".join(f"WHEN '{s.service}' THEN '{s.table}'" for s in SERVICES) + " END"
    flags_rows = " UNION ALL ".join(
        f"SELECT '{f}' AS f, * FROM ({USES[f].format(c='DISTINCT person_id, month')}) t" for f in USES
    )
    in_window = f"d >= {START} AND d < {END}"
    csv_columns = ", ".join(f"coalesce({c}, '') AS {c}" for c in ("id_text", "date_text", *PERSON_FIELDS))
    csv_columns += ", CASE WHEN service = 'pantry' THEN coalesce(household_text, '') END AS household_text"
    sql = {
        "parse_dates": texts
        + f'SELECT service, date_text, {parsed("date_text")} AS event_date, count(*) AS "rows" FROM raw GROUP BY ALL',
        "normalise_ids": texts + f'SELECT service, id_text, {number("id_text")} AS key, count(*) AS "rows" FROM raw GROUP BY ALL',
        "events_person_month": usage + "SELECT service, person_id, month FROM ev",
        "month_spine": texts
        + "SELECT CAST(i AS INTEGER) AS month_index, CAST(DATE '2000-07-01' + to_months(CAST(i AS INTEGER)) AS DATE) AS month, "
        + 'count(d) AS "rows" FROM range(12) r(i) LEFT JOIN '
        + f"(SELECT {number('id_text')} AS key, {parsed('date_text')} AS d FROM raw) x ON {in_window} AND key IS NOT NULL "
        + "AND CAST(date_trunc('month', d) AS DATE) = CAST(DATE '2000-07-01' + to_months(CAST(i AS INTEGER)) AS DATE) GROUP BY i",
        "pantry_served_person_month": usage + "SELECT person_id, month FROM served",
        "service_flags": usage
        + "SELECT person_id, month, "
        + ", ".join(f"bool_or(f = '{f}') AS {f}" for f in USES)
        + f" FROM ({flags_rows}) u GROUP BY person_id, month",
        "served_by_month": usage + monthly(served),
        "overlap_by_month": usage
        + f"SELECT month, {', '.join(overlaps)} FROM ({monthly(list(MEASURES))}) m",
        "annual_overlap": usage + annual(overlaps),
        "cross_service_monthly": usage + f"SELECT {', '.join(header)} FROM ({usage_report()}) r",
        "metrics_report_lines": usage
        + f"SELECT {usage_line} AS value FROM ({usage_report()}) r UNION ALL "
        + "SELECT unnest(['window_months,12', 'generated_at,2001-06-15T12:30:00.250Z', '', "
        + f"'{','.join(header)}'])",
        "age_group_counts": people + category("age_group"),
        "sex_counts": people + category("sex_at_birth"),
        "gender_grouped_counts": people + category("gender_identity_grouped"),
        "ethnicity_grouped_counts": people + category("ethnicity_grouped"),
        "race_grouped_counts": people + category("race_grouped"),
        "raw_value_counts": people + raw_values(),
        "raw_value_counts_any_case": people
        + f'SELECT category, min(value) AS value, CAST(sum("count") AS BIGINT) AS "count" FROM ({raw_values()}) r '
        + "GROUP BY category, lower(value)",
        "total_persons": people + "SELECT count(*) AS total_persons FROM person",
        "completeness_snapshot": people + completeness(),
        "demographics_profile": people + profile(),
        "demographics_report_lines": people
        + f"SELECT {profile_line} AS value FROM ({profile()}) r UNION ALL SELECT 'total_persons,' || count(*) FROM person "
        + "UNION ALL SELECT unnest(['', 'category,value,count,percent_of_total_persons'])",
        "rejected_events": texts
        + f'SELECT * FROM (SELECT {sources} AS source, {reasons} AS reason, count(*) AS "count" FROM raw GROUP BY ALL) r '
        + "WHERE reason IS NOT NULL",
        "multi_dob_people": multi_dob(),
        "multi_dob_names": f"SELECT * FROM ({multi_dob()}) m ORDER BY lower(trim(last_name)), lower(trim(first_name)), "
        + "dob NULLS FIRST, person_id LIMIT 200",
        "similar_names": similar(True, False, 0.75),
        "similar_names_loose": similar(True, False, 0.4),
        "similar_names_by_sound": similar(False, True, 0.7),
        "similar_names_any_block": similar(False, False, 0.8),
        "similar_names_top": f"SELECT * FROM ({similar(True, False, 0.75)}) s ORDER BY ratio_first + ratio_last DESC, "
        + "last_name_a, first_name_a, last_name_b, first_name_b, dob LIMIT 500",
        "person_merge": merges + merged_person(),
        "person_merge_audit": merges + merged_audit(),
        "household_merge": merges
        + "SELECT CAST(household_id AS DECIMAL(20, 0)) AS household_id, CAST(person_id AS DECIMAL(20, 0)) AS person_id FROM household "
        + "UNION SELECT l.household_id, CAST(p.person_id AS DECIMAL(20, 0)) FROM "
        + f"({pantry_links('t.key')}) l JOIN person p ON p.pantry_client_id = l.person_id",
        "latest_fields": merges + swept(),
        "rebuild_all": with_ctes(*records_ctes()[:3], *rebuilt_ctes()) + "SELECT * FROM person",
        "cross_service_after_rebuild": with_ctes(
            *records_ctes()[:3],
            *rebuilt_ctes(),
            f"household AS ({pantry_links(NEW_ID)})",
            KEYS,
            EVENTS,
            SERVED,
        )
        + f"SELECT {', '.join(header)} FROM ({usage_report()}) r",
        "rebuild_households": merges + pantry_links(NEW_ID),
        "csv_round_trip": with_ctes(exports_cte(merge=True)) + f"SELECT service, {csv_columns} FROM raw",
        "csv_width_reject": "SELECT CASE o_orderkey % 17 WHEN 0 THEN 'reject' ELSE 'accept' END AS verdict, "
        + "CASE o_orderkey % 17 WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS width, "
        + "CASE WHEN o_orderkey % 17 IN (1, 3) THEN NULL WHEN o_orderkey % 17 = 0 THEN 'quoted, once' ELSE 'a \"b\", c' END AS note, "
        + 'count(*) AS "rows" FROM orders WHERE o_orderkey % 17 <> 2 GROUP BY ALL',
        "stream_ingest": texts + "SELECT service, id_text, date_text FROM raw",
        "table_preview": "SELECT * FROM customer ORDER BY c_custkey LIMIT 200",
    }
    sql["person_merge_linked"] = linked_person()
    sql["person_merge_linked_audit"] = linked_audit()
    after_merge = f"{swept()} UNION ALL {inserted('fresh')}"
    sql["append_and_merge"] = merges + after_merge
    clinic = [c.replace("FROM raw)", "FROM raw WHERE service = 'clinic')") if c.startswith("typed") else c for c in merge_ctes()]
    sql["stream_and_merge"] = with_ctes(*clinic) + after_merge
    for name, months in (("cross_service_36_months", 36), ("cross_service_70_months_from_bits", 70)):
        sql[name] = with_ctes(*usage_ctes(months)) + f"SELECT {', '.join(header)} FROM ({usage_report(months)}) r"
    sql["cross_service_from_bits"] = sql["cross_service_monthly"]
    sql["cross_service_from_store"] = sql["cross_service_monthly"]
    return sql


assert [f.name for f in PERSON][1:4] == list(IDS)
