"""SQL for each registered query, over the given tables alone."""

from __future__ import annotations

from datetime import timedelta

from tallybook.catalog.inputs import CONFLICT_RULE, FEES, RULE_ROWS, TYPE_CLASS
from tallybook.catalog.queries import CTX, DRIFT, EVENT_DRIFT, RANGE
from tallybook.functions.dates import to_date
from tallybook.schema import CATEGORY_GROUPS, MONTH_NAMES_IT, OWNERS

ORACLES: dict[str, str] = {}

RAW = "txn_date, booking_date, description, amount, source_file, owner"
TAGGED = RAW + ", std_description, classification, channel, update_exception, essential, recurrent, product"
KEY = "txn_date, description, amount, owner, std_description, classification"
RULE_COLS = "rule_ord, name, classification, descriptions, update_exception, web, essential, recurrent, product_service"

SOURCE = """CASE WHEN o_orderpriority = '5-LOW' THEN 'spesa individuale' ELSE 'src_' || o_orderstatus END"""
OWNER = "CASE WHEN l_linestatus = 'F' THEN 'owner_a' ELSE 'owner_b' END"
ITEMS = f"""items AS (
  SELECT CAST(o_orderdate AS DATE) AS txn_date, CAST(l_shipdate AS DATE) AS booking_date, p_name AS description,
         l_extendedprice AS amount, {SOURCE} AS source_file, {OWNER} AS owner,
         l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_partkey, l_discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def day(d) -> str:
    return f"DATE '{to_date(d).isoformat()}'"


def between(window, column="txn_date") -> str:
    return f"{column} BETWEEN {day(window[0])} AND {day(window[1])}"


def money(column="amount") -> str:
    return f"CAST({column} AS DECIMAL(18,2))"


def total(column="amount") -> str:
    return f"CAST(SUM({money(column)}) AS DOUBLE)"


def cents(x: str) -> str:
    """Round to 2 digits, half even."""
    return f"round_even(({x}) * 100, 0) / 100"


def literal(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return "[" + ", ".join(literal(v) for v in value) + "]"
    return f"'{value}'" if isinstance(value, str) else str(value)


def rules_cte(rows) -> str:
    values = ",\n    ".join("(" + ", ".join(literal(v) for v in (i, *row)) + ")" for i, row in enumerate(rows, start=1))
    return f"""rules({RULE_COLS}) AS (VALUES
    {values}),
terms AS (SELECT name, UNNEST(descriptions) AS term FROM rules)"""


def std_cte(source="items", rows=RULE_ROWS) -> str:
    """Rules, and the standard name of every row of ``source``."""
    return f"""{rules_cte(rows)},
named AS (SELECT d.description, MIN(name) AS std_name FROM (SELECT DISTINCT description FROM {source}) d
  JOIN terms ON contains(d.description, term) GROUP BY d.description),
std AS (SELECT s.*, COALESCE(std_name, s.description) AS std_description FROM {source} s LEFT JOIN named USING (description))"""


def tag_cte(source="items") -> str:
    return f"""{std_cte(source)},
led AS (SELECT std.txn_date, std.booking_date, std.description, std.amount, std.source_file, std.owner, std.std_description,
    classification, CASE WHEN web THEN 'online' ELSE 'negozio' END AS channel, COALESCE(update_exception, false) AS update_exception,
    essential, recurrent, product_service AS product FROM std LEFT JOIN rules ON std_description = name)"""


LED = f"WITH {ITEMS},\n{tag_cte()}"

GROUPS = "groups(grp, grp_ord, classification) AS (VALUES " + ", ".join(
    f"('{g}', {i}, '{c}')" for i, (g, cs) in enumerate(CATEGORY_GROUPS.items(), start=1) for c in cs
) + ")"
MONTH = "CASE month({d}) " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MONTH_NAMES_IT, start=1)) + " END"


def month_it(d: str) -> str:
    return MONTH.format(d=d)


def italian(d: str) -> str:
    return f"strftime({d}, '%d/%m/%Y')"


def dotted(x: str) -> str:
    """Italian amount text of a positive number."""
    return f"translate(format('{{:,.2f}}', {x}), ',.', '.,')"


# --- scans, sources, sinks

ORACLES["scan_ledger"] = ORACLES["scan_ledger_csv"] = ORACLES["sink_csv"] = f"{LED} SELECT {TAGGED} FROM led"
ORACLES["sink_table"] = (
    f"{LED} SELECT * REPLACE (strftime(txn_date, '%Y-%m-%d') AS txn_date, strftime(booking_date, '%Y-%m-%d') AS booking_date) FROM led"
)
ORACLES["sink_update_in_place"] = f"""{LED} SELECT * REPLACE (CAST(txn_date + INTERVAL 12 MONTH AS DATE) AS txn_date) FROM (SELECT {TAGGED} FROM led) l WHERE owner = 'owner_a'"""
ORACLES["export_json"] = f"""{LED} SELECT '{{"txn_date":"' || CAST(txn_date AS VARCHAR) || '","booking_date":"' || CAST(booking_date AS VARCHAR)
  || '","description":"' || description || '","amount":' || CAST(amount AS VARCHAR) || ',"source_file":"' || source_file || '","owner":"' || owner
  || '","std_description":"' || std_description || '","classification":"' || classification || '","channel":"' || channel
  || '","update_exception":' || CAST(update_exception AS VARCHAR) || ',"essential":' || essential || ',"recurrent":' || recurrent
  || ',"product":' || product || '}}' AS record FROM led"""
ORACLES["type_dates"] = f"""WITH {ITEMS},
texts AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN {italian('booking_date')}
    WHEN l_linestatus = 'F' THEN strftime(booking_date, '%Y') || '-02-30' ELSE strftime(booking_date, '%Y-%m-%d') END AS date_text FROM items)
SELECT l_orderkey, l_linenumber, date_text, CAST(try_strptime(date_text, '%Y-%m-%d') AS DATE) AS booking_date FROM texts"""
ORACLES["parse_card_text"] = f"""WITH {ITEMS}
SELECT txn_date, booking_date, description, CASE WHEN l_returnflag = 'R' THEN -amount ELSE amount END AS amount, owner FROM items"""
ORACLES["pair_amounts"] = f"""WITH {ITEMS}
SELECT {italian('txn_date')} AS txn_text, {italian('booking_date')} AS booking_text,
  CASE WHEN l_returnflag = 'R' THEN description ELSE description || ' ' || {dotted('amount')} END AS description, {dotted('amount')} AS amount_text FROM items
UNION ALL
SELECT {italian('txn_date')}, {italian('booking_date')}, 'commissione', '1,50-' FROM items WHERE l_returnflag = 'R'"""
ORACLES["load_card_table"] = f"""WITH {ITEMS}
SELECT txn_date, CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN NULL ELSE booking_date END AS booking_date, description, amount, owner
FROM items WHERE l_returnflag <> 'R'"""
ORACLES["load_bank_table"] = f"WITH {ITEMS} SELECT txn_date, booking_date, description, amount, owner FROM items WHERE l_returnflag <> 'R'"
ORACLES["load_bank_pages"] = f"""WITH {ITEMS}
SELECT CASE WHEN l_returnflag = 'N' THEN DATE '2022-04-01' ELSE txn_date END AS txn_date,
  CASE WHEN l_returnflag = 'N' THEN DATE '2022-03-31' ELSE (CASE WHEN year(booking_date) < 2000 THEN booking_date + INTERVAL 100 YEAR ELSE booking_date END)::DATE END AS booking_date,
  description, CASE WHEN l_returnflag = 'N' THEN 3.6 ELSE amount END AS amount, 'conto.pdf' AS source_file, 'conto' AS owner
FROM items JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderstatus <> 'P' AND ((l_returnflag = 'N' AND l_linestatus = 'O') OR l_returnflag = 'A')"""
ORACLES["load_bank_pages"] = ORACLES["load_bank_pages"].replace(
    "ELSE txn_date END AS txn_date", "ELSE (CASE WHEN year(txn_date) < 2000 THEN txn_date + INTERVAL 100 YEAR ELSE txn_date END)::DATE END AS txn_date"
)
REFERENCE = "l_orderkey || '-' || l_linenumber || '-' || l_partkey"
NO_AMOUNT, NO_BOOKING = "l_returnflag = 'R' AND l_linestatus = 'F'", "l_returnflag = 'A' AND l_linestatus = 'O'"


def violations_sql(key: str, day: str, where: str = "true") -> str:
    return f"""WITH {ITEMS} SELECT {key}, 'amount' AS "column", 'n.d.' AS value, 'unreadable' AS problem FROM items WHERE {NO_AMOUNT} AND {where}
UNION ALL SELECT {key}, 'booking_date', '{day}', 'unreadable' FROM items WHERE {NO_BOOKING} AND {where}"""


ORACLES["csv_violations"] = violations_sql(f"{REFERENCE} AS reference", "2001-02-30")
ORACLES["card_violations"] = violations_sql(f'owner, {REFERENCE} AS "Riferimento"', "31/02/2001", "l_returnflag <> 'N'")
ORACLES["bank_violations"] = violations_sql(f"owner, {REFERENCE} AS riferimento", "31/02/2001", "l_returnflag <> 'N'")
ORACLES["page_violations"] = violations_sql("'conto.pdf' AS source_file, 'conto' AS owner, l_orderkey AS page, CAST(l_linenumber + 1 AS INTEGER) AS row_no", "31/02/01")
ORACLES["manual_violations"] = """SELECT 2 AS txn_date, 2 AS booking_date, 2 AS description, CASE WHEN o_orderstatus = 'O' THEN 3 END AS amount, 2 AS file, 2 AS owner
FROM orders WHERE o_orderstatus <> 'F'"""
ORACLES["load_manual_entries"] = """WITH halves AS (
  SELECT lower(o_orderpriority) AS description, o_totalprice AS amount, 'spesa individuale' AS source_file, o_orderdate, o_orderstatus FROM orders
  UNION ALL SELECT 'quota ' || o_orderkey, 10.5, 'spesa condivisa', o_orderdate, o_orderstatus FROM orders)
SELECT CAST(o_orderdate AS DATE) AS txn_date, CAST(o_orderdate AS DATE) AS booking_date, description, amount, source_file,
  CASE WHEN o_orderstatus = 'F' THEN 'owner_a' ELSE 'owner_b' END AS owner FROM halves"""
ORACLES["add_provenance"] = f"WITH {ITEMS} SELECT owner, 'txt' AS extension, 4 * COUNT(*) AS n_lines FROM items GROUP BY owner"

CASE_CLASS = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_CLASS.items()) + " END"
PART_RULES = f"""src AS (SELECT part.*, p_name || ' sku ' || p_partkey AS full_term, 'sku ' || p_partkey AS sku, lower(p_brand) || ' ' || p_partkey AS other,
    upper(p_name) || ' ' || p_partkey AS name FROM part),
rules AS (SELECT CAST(p_partkey + 1 AS INTEGER) AS rule_ord, name, {CASE_CLASS} AS classification,
    CASE WHEN p_size > 25 THEN [full_term, other, full_term] ELSE [full_term, sku] END AS terms,
    CASE WHEN p_size > 25 THEN full_term || '|' || other || '|' || full_term ELSE full_term || '|' || sku END AS descriptions,
    p_type = 'PROMO' AS update_exception, p_size <= 10 AS web, CASE WHEN p_type = 'SMALL' THEN 1 ELSE 0 END AS essential,
    CASE WHEN p_size > 40 THEN 1 ELSE 0 END AS recurrent, 1 AS product_service, p_type, p_size, p_name, full_term, other, sku FROM src)"""
RULES = f"WITH {PART_RULES}"
ORACLES["scan_rules"] = f"{RULES} SELECT {RULE_COLS} FROM rules"

ORACLES["scan_rules_ordered"] = f"{RULES} SELECT * REPLACE (CAST(ROW_NUMBER() OVER (ORDER BY rule_ord) AS INTEGER) AS rule_ord) FROM (SELECT {RULE_COLS} FROM rules) r"

# --- filters and expectations

ORACLES["filter_personal"] = f"{LED} SELECT {RAW} FROM led WHERE source_file <> 'spesa individuale'"
ORACLES["filter_range"] = f"{LED} SELECT {RAW} FROM led WHERE {between(RANGE)}"
START_BASE = f"{day(DRIFT[0])} - CAST({day(DRIFT[1])} - {day(DRIFT[0])} AS INTEGER)"
ORACLES["period_split"] = f"""{LED} SELECT {RAW}, CASE WHEN txn_date <= {day(DRIFT[0])} THEN 'base' ELSE 'eval' END AS period
FROM led WHERE txn_date > {START_BASE} AND txn_date <= {day(DRIFT[1])}"""
ORACLES["drop_exceptions"] = f"{LED} SELECT {TAGGED} FROM led WHERE NOT update_exception"
ORACLES["slice_by_index"] = f"""{LED}, ranked AS (SELECT classification, ROW_NUMBER() OVER (ORDER BY MAX(txn_date) DESC, classification) AS k FROM led GROUP BY classification)
SELECT {RAW}, led.classification FROM led JOIN ranked ON led.classification = ranked.classification WHERE k = 2"""
ORACLES["ledger_violations"] = f"""WITH {ITEMS},
bad AS (SELECT l_orderkey, l_linenumber, source_file,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN '2001-02-30' ELSE CAST(txn_date AS VARCHAR) END AS txn_date,
    CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'owner_c' ELSE owner END AS owner FROM items)
SELECT l_orderkey, l_linenumber, 'date_format:txn_date' AS rule, txn_date AS value FROM bad WHERE try_strptime(txn_date, '%Y-%m-%d') IS NULL
UNION ALL SELECT l_orderkey, l_linenumber, 'file_label', source_file FROM bad WHERE source_file NOT IN ('spesa individuale', 'src_F', 'src_O')
UNION ALL SELECT l_orderkey, l_linenumber, 'owner', owner FROM bad WHERE owner NOT IN ({', '.join(literal(o) for o in OWNERS)})"""
ORACLES["rules_by_flag"] = f"{RULES} SELECT {RULE_COLS} FROM rules WHERE update_exception"
ORACLES["rules_search"] = f"{RULES} SELECT {RULE_COLS} FROM rules WHERE contains(lower(name), 'old r')"

# --- rules

ORACLES["standardize"] = f"WITH {ITEMS}, {std_cte()} SELECT {RAW}, std_description FROM std"
PART_TEXTS = "texts AS (SELECT * REPLACE (description || ' sku ' || l_partkey AS description) FROM items)"
ORACLES["standardize_parts"] = f"""WITH {ITEMS}, {PART_RULES}, {PART_TEXTS},
terms AS (SELECT DISTINCT name, UNNEST(terms) AS term FROM rules),
named AS (SELECT d.description, MIN(name) AS std_name FROM (SELECT DISTINCT description FROM texts) d JOIN terms ON contains(d.description, term) GROUP BY d.description)
SELECT {RAW.replace('description', 'texts.description')}, COALESCE(std_name, texts.description) AS std_description FROM texts LEFT JOIN named ON texts.description = named.description"""
ORACLES["rule_conflicts"] = f"""WITH {ITEMS}, {rules_cte([*RULE_ROWS, CONFLICT_RULE])},
hits AS (SELECT DISTINCT d.description, name FROM (SELECT DISTINCT description FROM items) d JOIN terms ON contains(d.description, term))
SELECT description, string_agg(name, '|' ORDER BY name) AS names FROM hits GROUP BY description HAVING COUNT(*) > 1"""
ORACLES["classify"] = f"{LED} SELECT {RAW}, std_description, classification FROM led"
ORACLES["unclassified"] = f"""WITH {ITEMS}, {std_cte(rows=[r for r in RULE_ROWS if r[0] != 'WIDGET'])}
SELECT {RAW}, std_description FROM std WHERE std_description NOT IN (SELECT name FROM rules)"""
ORACLES["tag_attributes"] = f"{LED} SELECT * EXCLUDE (classification) FROM led"
ORACLES["map_category"] = f"{LED}, {GROUPS} SELECT {RAW}, classification, grp AS category FROM led LEFT JOIN groups USING (classification)"


def sum_between(start, end) -> str:
    return f"COALESCE(SUM(CASE WHEN {between((start, end))} THEN {money()} END), 0)"


CLASS_SUMS = f"""{LED}, sums AS (SELECT classification, CAST({sum_between(CTX.prev_month_start, CTX.prev_month_end)} AS DOUBLE) AS total,
    CAST({sum_between(CTX.year_start, CTX.prev_month_end)} AS DOUBLE) AS cur, CAST({sum_between(CTX.prev_year_start, CTX.prev_month_end_1y_ago)} AS DOUBLE) AS prev
  FROM led GROUP BY classification),
summary AS (SELECT classification, total, round((cur - prev) / NULLIF(prev, 0) * 100, 6) AS delta_pct FROM sums)"""
ORACLES["class_summary"] = f"{CLASS_SUMS} SELECT * FROM summary"
ORACLES["class_totals_prev_month"] = f"{CLASS_SUMS} SELECT classification, total FROM summary"
ORACLES["class_delta_ytd"] = f"{CLASS_SUMS} SELECT classification, delta_pct FROM summary"
ORACLES["rule_overlaps"] = rf"""{RULES},
entries AS (SELECT rule_ord, name, classification, UNNEST(terms) AS term, UNNEST(range(len(terms))) AS pos FROM rules)
SELECT a.term, a.name AS entity, a.classification, b.term AS matches_with, b.name AS other_entity, b.classification AS other_classification,
  'Overlap: ''' || a.term || ''' (' || a.name || ') occurs in ''' || b.term || ''' (' || b.name || ')' AS summary
FROM entries a JOIN entries b ON contains(b.term, a.term) AND (a.rule_ord <> b.rule_ord OR a.pos <> b.pos)
WHERE regexp_matches(b.term, '(^|\W)' || regexp_escape(a.term) || '(\W|$)')"""
ORACLES["overlap_classes"] = rf"""{RULES},
sizes AS (SELECT term, COUNT(*) AS n FROM (SELECT UNNEST(terms) AS term FROM rules) GROUP BY term)
SELECT a.term, b.term AS matches_with, a.n AS n_entries, b.n AS n_others, a.n * (b.n - CASE WHEN a.term = b.term THEN 1 ELSE 0 END) AS n_pairs
FROM sizes a JOIN sizes b ON contains(b.term, a.term) AND (a.term <> b.term OR a.n > 1)
WHERE regexp_matches(b.term, '(^|\W)' || regexp_escape(a.term) || '(\W|$)')"""
ORACLES["rule_counts"] = f"{RULES} SELECT classification, COUNT(*) AS n_rules FROM rules GROUP BY classification"
ORACLES["rule_terms"] = f"{RULES} SELECT rule_ord, name, CAST(UNNEST(range(len(terms))) AS INTEGER) AS pos, UNNEST(terms) AS term FROM rules"
ORACLES["rule_names_by_class"] = f"""{RULES}
SELECT MIN(rule_ord) OVER (PARTITION BY classification) AS class_ord, classification, rule_ord, name FROM rules"""

# --- series and reports


def series_cte(name: str, grain: str, source: str, where: str = "true", by: str = "", value: str = "amount") -> str:
    """A gap-free series of sums (DOUBLE) by bucket and optional group column."""
    start = {"D": "txn_date", "W": "CAST(date_trunc('week', txn_date) AS DATE)", "M": "CAST(date_trunc('month', txn_date) AS DATE)"}[grain]
    step = {"D": "1 DAY", "W": "7 DAY", "M": "1 MONTH"}[grain]
    label = {"D": "b", "W": "b + 6", "M": "last_day(b)"}[grain]
    group = f"{by}, " if by else ""
    span_by = f"GROUP BY {by}" if by else ""
    on = f"AND s.{by} = p.{by}" if by else ""
    return f"""{name}_s AS (SELECT {group}{start} AS b, SUM({money(value)}) AS v FROM {source} WHERE {where} GROUP BY {group}{start}),
{name}_p AS (SELECT {group}CAST(UNNEST(generate_series(MIN(b), MAX(b), INTERVAL {step})) AS DATE) AS b FROM {name}_s {span_by}),
{name} AS (SELECT {f'p.{by}, ' if by else ''}CAST({label.replace('b', 'p.b', 1) if grain != 'M' else 'last_day(p.b)'} AS DATE) AS bucket, CAST(COALESCE(v, 0) AS DOUBLE) AS total
  FROM {name}_p p LEFT JOIN {name}_s s ON s.b = p.b {on})"""


for _g in "DWM":
    ORACLES[f"resample_{_g.lower()}"] = f"{LED}, {series_cte('r', _g, 'led')} SELECT bucket, total FROM r"

# Whole hundredths times whole hundredths, so that no sum is ever rounded.
ORACLES["resample_discounts"] = f"""WITH {ITEMS},
sums AS (SELECT owner, txn_date, SUM(CAST(round(amount * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) AS v FROM items GROUP BY ALL),
days AS (SELECT owner, CAST(UNNEST(generate_series(MIN(txn_date), MAX(txn_date), INTERVAL 1 DAY)) AS DATE) AS bucket FROM sums GROUP BY owner)
SELECT d.owner, d.bucket, COALESCE(CAST(v AS BIGINT), 0) / 10000 AS total FROM days d LEFT JOIN sums s ON s.owner = d.owner AND s.txn_date = d.bucket"""

REPORT = between(CTX.report_window)
DESCRIBE_STATS = {
    "count": "CAST(COUNT(total) AS DOUBLE)", "mean": "AVG(total)", "std": "STDDEV_SAMP(total)", "min": "MIN(total)",
    "25%": "QUANTILE_CONT(total, 0.25)", "50%": "QUANTILE_CONT(total, 0.5)", "75%": "QUANTILE_CONT(total, 0.75)", "max": "MAX(total)",
}
DESCRIBE = f"{LED}, " + ", ".join(series_cte(g.lower(), g, "led", REPORT) for g in "DWM") + ", described AS (" + " UNION ALL ".join(
    f"SELECT '{s}' AS statistic, (SELECT round({e}, 4) FROM d) AS day, (SELECT round({e}, 4) FROM w) AS week, (SELECT round({e}, 4) FROM m) AS month"
    for s, e in DESCRIBE_STATS.items()
) + ")"
ORACLES["describe_series"] = f"{DESCRIBE} SELECT * FROM described"
ORACLES["monthly_totals"] = f"{LED}, {series_cte('m', 'M', 'led', REPORT)} SELECT bucket, {month_it('bucket')} AS month, total FROM m"

GROUP_NAMES = list(CATEGORY_GROUPS)


def matrix_cte(window) -> str:
    cells = ", ".join(f"COALESCE(SUM(CASE WHEN grp = '{g}' THEN CAST(total AS DECIMAL(18,2)) END), 0) AS {g}" for g in GROUP_NAMES)
    return f"""{GROUPS}, grouped AS (SELECT led.*, grp FROM led JOIN groups USING (classification)),
{series_cte('g', 'M', 'grouped', between(window), 'grp')},
cells AS (SELECT bucket, {cells} FROM g GROUP BY bucket),
matrix AS (SELECT bucket, {', '.join(f'CAST({g} AS DOUBLE) AS {g}' for g in GROUP_NAMES)}, CAST({' + '.join(GROUP_NAMES)} AS DOUBLE) AS Totale FROM cells)"""


MATRIX = f"{LED}, {matrix_cte(CTX.report_window)}"
ORACLES["expense_matrix"] = f"{MATRIX} SELECT * FROM matrix"
MATRIX_COLUMNS = [*GROUP_NAMES, "Totale"]
MEAN_ROWS = f"""SELECT CAST(bucket AS VARCHAR) AS bucket, {', '.join(f'{cents(c)} AS {c}' for c in MATRIX_COLUMNS)} FROM matrix
UNION ALL SELECT 'Mean', {', '.join(f'round_even(SUM(CAST(round({c} * 100) AS BIGINT)) / COUNT(*), 0) / 100' for c in MATRIX_COLUMNS)} FROM matrix"""
ORACLES["expense_matrix_mean"] = f"{MATRIX} {MEAN_ROWS}"

YEAR = CTX.day.year


def year_cte(name: str, year: int) -> str:
    return f"""{name} AS (SELECT COALESCE(grp, '(unmapped)') AS category, month(txn_date) AS month_no, {money()} AS amount
  FROM led LEFT JOIN groups USING (classification) WHERE year(txn_date) = {year})"""


def pivot_sql(source: str, year: int) -> str:
    def cell(i):
        return "CAST(0 AS DOUBLE)" if year == YEAR and i == CTX.day.month else f"CAST(COALESCE(SUM(amount) FILTER (month_no = {i}), 0) AS DOUBLE)"

    cells = ", ".join(f"{cell(i)} AS {m}" for i, m in enumerate(MONTH_NAMES_IT, start=1))
    return f"""SELECT category, {cells}, CAST(SUM(amount) AS DOUBLE) AS Totale FROM {source} GROUP BY category
UNION ALL SELECT 'Totale', {cells}, CAST(SUM(amount) AS DOUBLE) FROM {source}"""


def delta_sql(year: int) -> str:
    cut = f"AND month(txn_date) < {CTX.day.month}" if year == YEAR else ""
    return f"""SELECT CASE WHEN GROUPING(category) = 1 THEN 'Totale' ELSE category END AS category,
  CAST(SUM(cur) AS DOUBLE) AS this_year, CAST(SUM(prev) AS DOUBLE) AS last_year,
  round((CAST(SUM(cur) AS DOUBLE) - CAST(SUM(prev) AS DOUBLE)) / NULLIF(CAST(SUM(prev) AS DOUBLE), 0) * 100, 6) AS delta_pct
FROM (SELECT COALESCE(grp, '(unmapped)') AS category, CASE WHEN year(txn_date) = {year} THEN {money()} ELSE 0 END AS cur,
    CASE WHEN year(txn_date) = {year - 1} THEN {money()} ELSE 0 END AS prev
  FROM led LEFT JOIN groups USING (classification)
  WHERE year(txn_date) = {year} OR (year(txn_date) = {year - 1} {cut})) x GROUP BY ROLLUP (category)"""


ORACLES["budget_pivot"] = f"{LED}, {GROUPS}, {year_cte('y', YEAR)} {pivot_sql('y', YEAR)}"
ORACLES["budget_delta"] = f"{LED}, {GROUPS} {delta_sql(YEAR)}"
ORACLES["budget_cube"] = f"""{LED}, {GROUPS}, {year_cte('y', YEAR - 1)}
SELECT CASE WHEN GROUPING(category) = 1 THEN 'Totale' ELSE category END AS category, CAST(COALESCE(month_no, 0) AS INTEGER) AS month_no,
  CASE WHEN GROUPING(month_no) = 1 THEN 'Totale' ELSE {month_it("make_date(2000, CAST(month_no AS INTEGER), 1)")} END AS month, CAST(SUM(amount) AS DOUBLE) AS total
FROM y GROUP BY CUBE (category, month_no)"""
MELTED = " UNION ALL ".join(f"SELECT '{c}' AS series, bucket, {c} AS total FROM matrix" for c in MATRIX_COLUMNS)
FORECAST = """placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series ORDER BY bucket) - 1 AS t FROM melted),
fit AS (SELECT series, COALESCE(regr_slope(total, t), 0) AS b, COALESCE(regr_intercept(total, t), AVG(total)) AS a, MAX(bucket) AS last_bucket, COUNT(*) AS n FROM placed GROUP BY series),
effect AS (SELECT p.series, month(bucket) AS m, AVG(total - (a + b * t)) AS e FROM placed p JOIN fit USING (series) GROUP BY ALL),
future AS (SELECT fit.*, k, CAST(last_day(CAST(date_trunc('month', last_bucket) + k * INTERVAL 1 MONTH AS DATE)) AS DATE) AS bucket FROM fit, (VALUES (1), (2), (3)) steps(k))"""
ORACLES["forecast_monthly"] = f"""{LED}, {matrix_cte(('1995-01-01', CTX.prev_month_end))},
melted AS ({MELTED}), {FORECAST}
SELECT f.series, f.bucket, round(a + b * (n + k - 1) + COALESCE(e, 0), 4) AS total FROM future f LEFT JOIN effect ON f.series = effect.series AND month(f.bucket) = m"""

# --- dashboard

DASH = f"{LED}, rows_in AS (SELECT * FROM led WHERE {between(RANGE)})"
ORACLES["top_vendors"] = f"""{DASH} SELECT std_description, lower(substr(std_description, 1, 10)) AS label, {total()} AS total, round({total()} / COUNT(*), 4) AS mean
FROM rows_in GROUP BY std_description ORDER BY total DESC, std_description LIMIT 10"""
ORACLES["channel_share"] = f"""{DASH}, sums AS (SELECT channel, {total()} AS total FROM rows_in GROUP BY channel),
listed(channel) AS (VALUES ('negozio'), ('online'))
SELECT channel, COALESCE(total, 0) AS total, round(COALESCE(total, 0) / (SELECT SUM(total) FROM sums) * 100, 6) AS share_pct FROM listed LEFT JOIN sums USING (channel)"""
ORACLES["product_share"] = f"""{DASH} SELECT 'prodotti' AS kind, round(AVG(product) * 100, 6) AS share_pct FROM rows_in
UNION ALL SELECT 'servizi', round(100 - AVG(product) * 100, 6) FROM rows_in"""
ORACLES["flag_shares"] = f"""{DASH} SELECT 'recurrent' AS kind, round(AVG(recurrent) * 100, 6) AS share_pct FROM rows_in
UNION ALL SELECT 'essential', round(AVG(essential) * 100, 6) FROM rows_in
UNION ALL SELECT 'essential_and_recurrent', round(AVG(CASE WHEN essential = 1 AND recurrent = 1 THEN 1.0 ELSE 0.0 END) * 100, 6) FROM rows_in
UNION ALL SELECT 'neither', round(AVG(CASE WHEN essential = 0 AND recurrent = 0 THEN 1.0 ELSE 0.0 END) * 100, 6) FROM rows_in"""
ORACLES["flag_trend"] = f"""{DASH} SELECT CAST(date_trunc('month', txn_date) AS DATE) AS month_start, round(AVG(essential) * 100, 6) AS essential_pct,
  round(AVG(recurrent) * 100, 6) AS recurrent_pct FROM rows_in GROUP BY 1"""
SERIES = f"""{DASH},
ends AS (SELECT CAST(last_day(CAST(m AS DATE)) AS DATE) AS bucket FROM generate_series(date_trunc('month', {day(RANGE[0])}), date_trunc('month', {day(RANGE[1])}), INTERVAL 1 MONTH) x(m)
  WHERE last_day(CAST(m AS DATE)) <= {day(RANGE[1])}),
classes AS (SELECT classification, SUM({money()}) AS in_range, ROW_NUMBER() OVER (ORDER BY SUM({money()}) DESC, classification) AS class_rank FROM rows_in GROUP BY classification),
sums AS (SELECT classification, last_day(txn_date) AS bucket, SUM({money()}) AS v FROM rows_in GROUP BY ALL),
exact AS (SELECT c.classification, e.bucket, COALESCE(v, 0) AS v, class_rank FROM classes c CROSS JOIN ends e LEFT JOIN sums s ON s.classification = c.classification AND s.bucket = e.bucket),
series AS (SELECT classification, bucket, CAST(v AS DOUBLE) AS total, CAST(SUM(v) OVER (PARTITION BY classification) AS DOUBLE) AS class_total, CAST(class_rank AS INTEGER) AS class_rank FROM exact)"""
ORACLES["class_series"] = f"""{SERIES} SELECT classification, bucket, total, class_total,
  round(class_total / (SELECT CAST(SUM({money()}) AS DOUBLE) FROM rows_in) * 100, 6) AS share_pct, class_rank FROM series"""
ORACLES["class_cumsum"] = f"""{SERIES} SELECT classification, bucket, total,
  CAST(SUM({money('total')}) OVER (PARTITION BY classification ORDER BY bucket) AS DOUBLE) AS running_total FROM series"""
ORACLES["class_trend"] = f"""{SERIES}, placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY classification ORDER BY bucket) - 1 AS t FROM series),
fit AS (SELECT classification, regr_slope(total, t) AS b, regr_intercept(total, t) AS a, round_even(AVG(total), 0) AS mean FROM placed GROUP BY classification)
SELECT classification, bucket, total, round(b, 4) AS slope, round(a, 4) AS intercept, round(a + b * t, 4) AS fitted, mean FROM placed JOIN fit USING (classification)"""
YEARS = f"""{LED}, {series_cte('ym', 'M', 'led', f"txn_date BETWEEN {day(RANGE[0])} - 365 AND {day(RANGE[1])}")},
months AS (SELECT CAST(year(bucket) AS INTEGER) AS year, CAST(month(bucket) AS INTEGER) AS month_no, {month_it('bucket')} AS month, NULLIF(total, 0) AS total FROM ym)"""
COMPARED = range(RANGE[0].year - 1, RANGE[1].year + 1)
ORACLES["year_compare"] = f"""{YEARS} SELECT month_no, month, {', '.join(f'SUM(total) FILTER (year = {y}) AS y{y}' for y in COMPARED)} FROM months GROUP BY month_no, month"""
ORACLES["year_stats"] = f"""{YEARS}, means AS (SELECT year, AVG(total) AS mean FROM months GROUP BY year)
SELECT year, round(mean, 4) AS mean, round((mean / LAG(mean) OVER (ORDER BY year) - 1) * 100, 6) AS change_pct FROM means"""
ORACLES["year_cumsum"] = f"""{YEARS} SELECT year, month_no, total, CASE WHEN total IS NOT NULL THEN
  CAST(SUM({money('total')}) OVER (PARTITION BY year ORDER BY month_no) AS DOUBLE) END AS running_total FROM months"""

# --- quality

def redelivered(condition: str) -> str:
    return f"""WITH {ITEMS},
twice AS (SELECT * FROM items UNION ALL SELECT * REPLACE ('redelivered' AS source_file) FROM items WHERE {condition}),
{tag_cte('twice')}"""


REDELIVERED = redelivered("source_file = 'src_P'")
ORACLES["duplicates"] = f"""{REDELIVERED}, ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {KEY}
    ORDER BY source_file, booking_date, channel, update_exception, essential, recurrent, product) AS rn FROM led)
SELECT {TAGGED} FROM ranked WHERE rn > 1"""
REST = "txn_date, booking_date, amount, source_file, owner, std_description, classification, channel, update_exception, essential, recurrent, product"
SUFFIXED = f"""sized AS (SELECT *, COUNT(*) OVER (PARTITION BY {KEY}) AS size FROM led),
numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {REST}, size > 1 ORDER BY description) AS k FROM sized),
unique_led AS (SELECT * EXCLUDE (size, k) REPLACE (CASE WHEN size > 1 THEN description || '_' || k ELSE description END AS description) FROM numbered)"""
ORACLES["dedup_suffix"] = f"{REDELIVERED}, {SUFFIXED} SELECT {TAGGED} FROM unique_led"
ORACLES["derived_fees"] = f"""WITH {ITEMS}, files AS (SELECT source_file || '_' || strftime(txn_date, '%Y-%m') AS source_file, owner, MIN(txn_date) AS first_day, SUM({money()}) AS v
  FROM items GROUP BY ALL)
SELECT first_day AS txn_date, first_day AS booking_date, 'imposta di bollo' AS description, CAST(2 AS DOUBLE) AS amount, source_file, owner
FROM files WHERE first_day > DATE '2001-01-01' AND v > 77.47"""
ORACLES["ledger_sorted"] = f"{LED} SELECT {TAGGED} FROM led"
ORACLES["union_sources"] = f"""{LED} SELECT {RAW}, std_description, classification, channel FROM led
UNION ALL SELECT {RAW}, NULL, NULL, NULL FROM items"""

# --- drift

ORACLES["drift_new_values"] = f"""{LED}, kept AS (SELECT * FROM led WHERE NOT (std_description = 'WIDGET' AND txn_date <= {day(DRIFT[0])})),
base AS (SELECT * FROM kept WHERE txn_date > {START_BASE} AND txn_date <= {day(DRIFT[0])}),
eval AS (SELECT * FROM kept WHERE txn_date > {day(DRIFT[0])} AND txn_date <= {day(DRIFT[1])})
SELECT DISTINCT 'classification' AS column_name, classification AS value FROM eval WHERE classification NOT IN (SELECT classification FROM base)
UNION ALL SELECT DISTINCT 'std_description', std_description FROM eval WHERE std_description NOT IN (SELECT std_description FROM base)"""


def profile_sql(source: str, by: str) -> str:
    skew = "sqrt(COUNT(*) * (COUNT(*) - 1.0)) / (COUNT(*) - 2) * AVG(d3) / pow(AVG(d2), 1.5)"
    return f"""(WITH means AS (SELECT {by}, AVG(total) AS mu FROM {source} GROUP BY {by}),
  centred AS (SELECT s.*, pow(total - mu, 3) AS d3, pow(total - mu, 2) AS d2 FROM {source} s JOIN means USING ({by})),
  counted AS (SELECT {by}, total, COUNT(*) AS n FROM {source} GROUP BY {by}, total),
  modes AS (SELECT {by}, MAX(total) AS mode FROM counted c WHERE n = (SELECT MAX(n) FROM counted k WHERE k.{by} = c.{by}) GROUP BY {by})
SELECT {by}, mode, MEDIAN(total) AS median, AVG(total) AS mean, CASE WHEN COUNT(*) >= 3 THEN CASE WHEN AVG(d2) = 0 THEN 0 ELSE {skew} END END AS skewness,
  CAST(COUNT(*) AS DOUBLE) AS "count", STDDEV_SAMP(total) AS std, MIN(total) AS min, QUANTILE_CONT(total, 0.25) AS "25%", MEDIAN(total) AS "50%",
  QUANTILE_CONT(total, 0.75) AS "75%", MAX(total) AS max FROM centred JOIN modes USING ({by}) GROUP BY {by}, mode)"""


STATS = ["mode", "median", "mean", "skewness", "count", "std", "min", "25%", "50%", "75%", "max"]
ORACLES["numeric_profile"] = f"""{LED}, {series_cte('s', 'D', 'led', by='classification')},
profile AS {profile_sql('s', 'classification')} SELECT classification, {', '.join(f'round("{s}", 4) AS "{s}"' for s in STATS)} FROM profile"""
EV_START = f"{day(EVENT_DRIFT[0])} - CAST({day(EVENT_DRIFT[1])} - {day(EVENT_DRIFT[0])} AS INTEGER)"
EVENTS = f"""WITH ev AS (SELECT CAST(ts AS DATE) AS txn_date, event_type, value AS amount,
    CASE WHEN CAST(ts AS DATE) <= {day(EVENT_DRIFT[0])} THEN 'base' ELSE 'eval' END AS period FROM events
  WHERE CAST(ts AS DATE) > {EV_START} AND CAST(ts AS DATE) <= {day(EVENT_DRIFT[1])}),
{series_cte('s', 'D', 'ev', by='period')}"""
NUMERIC = f"""profile AS {profile_sql('s', 'period')},
long AS (UNPIVOT (SELECT period, {', '.join(f'round(CAST("{s}" AS DOUBLE), 9) AS "{s}"' for s in STATS)} FROM profile) ON {', '.join(f'"{s}"' for s in STATS)} INTO NAME statistic VALUE v),
sides AS (SELECT statistic, MAX(v) FILTER (period = 'base') AS b, MAX(v) FILTER (period = 'eval') AS e FROM long GROUP BY statistic),
numeric_drift AS (SELECT statistic, {cents('b')} AS base, {cents('e')} AS eval,
  CASE WHEN b = 0 THEN 0 ELSE {cents(cents('(e - b) / b') + ' * 100')} END AS diff_pct FROM sides)"""
ORACLES["drift_numeric"] = f"{EVENTS}, {NUMERIC} SELECT * FROM numeric_drift"
HISTOGRAM = """limits AS (SELECT period, CASE WHEN MIN(total) = MAX(total) THEN MIN(total) - 0.5 ELSE MIN(total) END AS lo,
    CASE WHEN MIN(total) = MAX(total) THEN MAX(total) + 0.5 ELSE MAX(total) END AS hi FROM s GROUP BY period),
placed AS (SELECT period, LEAST(20, CAST(floor(20 * (total - lo) / (hi - lo)) AS INTEGER) + 1) AS bin, COUNT(*) AS n FROM s JOIN limits USING (period) GROUP BY ALL),
hist AS (SELECT l.period, CAST(k AS INTEGER) AS bin, round(lo + (hi - lo) / 20 * (k - 1), 6) AS bin_from, round(lo + (hi - lo) / 20 * k, 6) AS bin_to, COALESCE(n, 0) AS n
  FROM limits l CROSS JOIN range(1, 21) r(k) LEFT JOIN placed p ON p.period = l.period AND p.bin = k)"""
ORACLES["drift_histogram"] = f"{EVENTS}, {HISTOGRAM} SELECT * FROM hist"

# --- scalars

SIGNED = f"CASE WHEN l_returnflag = 'R' THEN {dotted('amount')} || '-' ELSE {dotted('amount')} END"
ORACLES["scalar_functions"] = f"""WITH {ITEMS} SELECT l_orderkey, l_linenumber, {SIGNED} AS amount_text,
  CASE WHEN l_returnflag = 'R' THEN -amount ELSE amount END AS amount_trailing, -amount AS amount_leading, CAST(NULL AS DOUBLE) AS amount_none, amount AS amount_abs,
  txn_date AS day_first, CAST(CASE WHEN year(txn_date) < 2000 THEN txn_date + INTERVAL 100 YEAR ELSE txn_date END AS DATE) AS short_year,
  {month_it('txn_date')} AS month_name, last_day(txn_date) AS month_end, CAST(date_trunc('month', txn_date) AS DATE) AS month_start,
  txn_date - 365 AS year_before, CAST(booking_date - INTERVAL 12 MONTH AS DATE) AS months_before,
  {cents('amount / 7')} AS rounded_2, round_even(floor(amount) / 2, 0) AS rounded_0,
  format('{{:.2f}}%', floor(amount) / 100) AS percent, lower(substr(upper(description) || ' STORE', 1, 10)) AS label,
  description || '_' || l_linenumber AS suffixed, NULLIF(CAST(l_linenumber - 1 AS DOUBLE), 0) AS zero_as_null, CAST(l_linenumber - 1 AS DOUBLE) AS null_as_zero,
  description AS trimmed, CAST(booking_date - txn_date AS INTEGER) AS days_between, contains(description, 'd r') AS has_literal FROM items"""
ORACLES["date_context"] = f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS txn_date FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
s AS (SELECT txn_date, CAST(date_trunc('month', txn_date) AS DATE) AS m, CAST(date_trunc('year', txn_date) AS DATE) AS y FROM d)
SELECT txn_date, y AS year_start, CAST(y - INTERVAL 1 YEAR AS DATE) AS prev_year_start, CAST(m - INTERVAL 1 MONTH AS DATE) AS prev_month_start, m - 1 AS prev_month_end,
  CAST((m - 1) - INTERVAL 1 YEAR AS DATE) AS prev_month_end_1y_ago, CAST(m - INTERVAL 1 YEAR AS DATE) AS month_start_1y_ago, CAST(m - INTERVAL 2 YEAR AS DATE) AS month_start_2y_ago,
  CAST(m - INTERVAL 3 MONTH AS DATE) - 1 AS end_3_months_before, {month_it('m - 1')} AS prev_month_name, CAST(year(m - 1) AS VARCHAR) AS prev_month_year,
  CAST(m - INTERVAL 1 YEAR AS DATE) AS report_start, m - 1 AS report_end FROM s"""

# --- bundles

ORACLES["load_ledger"] = f"""WITH {ITEMS},
arrived AS (SELECT * FROM items WHERE l_returnflag <> 'R' AND source_file <> 'spesa individuale'
  UNION ALL SELECT * FROM items WHERE l_returnflag = 'R'
  UNION ALL SELECT * REPLACE ('redelivered' AS source_file) FROM items WHERE l_returnflag = 'R'),
{tag_cte('arrived')}, {SUFFIXED}
SELECT {TAGGED} FROM unique_led WHERE NOT update_exception"""


def melt(section: str, item: str, source: str, fields: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{section}' AS section, CAST({item} AS VARCHAR) AS item, '{f}' AS field, round(CAST("{f}" AS DOUBLE), 6) AS value FROM {source}""" for f in fields
    )


BUDGETS = ", ".join(
    f"{year_cte(f'y{y}', y)}, p{y} AS ({pivot_sql(f'y{y}', y)}), d{y} AS ({delta_sql(y)})" for y in (YEAR, YEAR - 1)
)
ORACLES["report_long"] = f"""{DESCRIBE}, {series_cte('mt', 'M', 'led', REPORT)},
{CLASS_SUMS[len(LED) + 2:]}, {matrix_cte(CTX.report_window)}, shown AS ({MEAN_ROWS}), {BUDGETS}
{melt('statistics', 'statistic', 'described', ['day', 'week', 'month'])}
UNION ALL {melt('monthly', 'bucket', 'mt', ['total'])}
UNION ALL {melt('classes', 'classification', 'summary', ['total', 'delta_pct'])}
UNION ALL {melt('expenses', 'bucket', 'shown', MATRIX_COLUMNS)}
UNION ALL {melt('budget', 'category', f'p{YEAR}', [*MONTH_NAMES_IT, 'Totale'])}
UNION ALL {melt('budget', 'category', f'd{YEAR}', ['delta_pct'])}
UNION ALL {melt('budget_previous', 'category', f'p{YEAR - 1}', [*MONTH_NAMES_IT, 'Totale'])}
UNION ALL {melt('budget_previous', 'category', f'd{YEAR - 1}', ['delta_pct'])}"""
ORACLES["validate_long"] = f"""{EVENTS}, {NUMERIC}, {HISTOGRAM},
news AS (SELECT DISTINCT event_type FROM ev WHERE period = 'eval' AND event_type NOT IN (SELECT event_type FROM ev WHERE period = 'base'))
SELECT 'numeric' AS section, statistic AS item, base, eval, diff_pct FROM numeric_drift
UNION ALL SELECT 'histogram', CAST(bin AS VARCHAR), CAST(SUM(n) FILTER (period = 'base') AS DOUBLE), CAST(SUM(n) FILTER (period = 'eval') AS DOUBLE), NULL FROM hist GROUP BY bin
UNION ALL SELECT 'new:classification', event_type, NULL, NULL, NULL FROM news
UNION ALL SELECT 'new:std_description', event_type, NULL, NULL, NULL FROM news"""
# The columns that name a row, and the numbers, of each dashboard table.
DASHBOARD = {
    "class_series": ("classification || '|' || bucket", ["total", "class_total", "share_pct", "class_rank"]),
    "class_cumsum": ("classification || '|' || bucket", ["total", "running_total"]),
    "class_trend": ("classification || '|' || bucket", ["total", "slope", "intercept", "fitted", "mean"]),
    "year_compare": ("month_no", [f"y{y}" for y in range((to_date(RANGE[0]) - timedelta(days=365)).year, to_date(RANGE[1]).year + 1)]),
    "year_cumsum": ("year || '|' || month_no", ["total", "running_total"]),
    "year_stats": ("year", ["mean", "change_pct"]),
    "top_vendors": ("std_description", ["total", "mean"]),
    "channel_share": ("channel", ["total", "share_pct"]),
    "product_share": ("kind", ["share_pct"]),
    "flag_shares": ("kind", ["share_pct"]),
    "flag_trend": ("month_start", ["essential_pct", "recurrent_pct"]),
}
ORACLES["dashboard_long"] = " UNION ALL ".join(
    f"""SELECT '{section}' AS section, item, field, round(value, 6) AS value FROM (SELECT CAST({item} AS VARCHAR) AS item, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in fields)}
FROM ({ORACLES[section]}) t) UNPIVOT INCLUDE NULLS (value FOR field IN ({', '.join(fields)}))"""
    for section, (item, fields) in DASHBOARD.items()
)
ORACLES["expense_report_forecast"] = f"""{MATRIX}, melted AS ({MELTED}), {FORECAST},
told AS (SELECT bucket, {', '.join(f"MAX(total) FILTER (series = '{c}') AS {c}" for c in MATRIX_COLUMNS)} FROM
  (SELECT f.series, f.bucket, a + b * (n + k - 1) + COALESCE(e, 0) AS total FROM future f LEFT JOIN effect ON f.series = effect.series AND month(f.bucket) = m) GROUP BY bucket),
whole AS (SELECT bucket, {', '.join(MATRIX_COLUMNS)} FROM matrix UNION ALL SELECT bucket, {', '.join(MATRIX_COLUMNS)} FROM told)
SELECT CAST(bucket AS VARCHAR) AS bucket, {', '.join(f'{cents(c)} AS {c}' for c in MATRIX_COLUMNS)} FROM whole
UNION ALL SELECT 'Mean', {', '.join(f'{cents(f"AVG({c})")} AS {c}' for c in MATRIX_COLUMNS)} FROM whole"""
ORACLES["validate_ledger_slice"] = f"""{LED}, ranked AS (SELECT classification, ROW_NUMBER() OVER (ORDER BY MAX(txn_date) DESC, classification) AS k FROM led GROUP BY classification),
ev AS (SELECT led.*, CASE WHEN txn_date <= {day(DRIFT[0])} THEN 'base' ELSE 'eval' END AS period FROM led JOIN ranked ON led.classification = ranked.classification
  WHERE k = 2 AND txn_date > {START_BASE} AND txn_date <= {day(DRIFT[1])}),
{series_cte('s', 'D', 'ev', by='period')}, {NUMERIC}, {HISTOGRAM}
SELECT 'numeric' AS section, statistic AS item, base, eval, diff_pct FROM numeric_drift
UNION ALL SELECT 'histogram', CAST(bin AS VARCHAR), CAST(SUM(n) FILTER (period = 'base') AS DOUBLE), CAST(SUM(n) FILTER (period = 'eval') AS DOUBLE), NULL FROM hist GROUP BY bin
UNION ALL SELECT DISTINCT 'new:std_description', std_description, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM ev WHERE period = 'eval' AND std_description NOT IN (SELECT std_description FROM ev WHERE period = 'base')
UNION ALL SELECT DISTINCT 'new:classification', classification, NULL, NULL, NULL FROM ev WHERE period = 'eval' AND classification NOT IN (SELECT classification FROM ev WHERE period = 'base')"""
ORACLES["stream_ingest"] = f"""{redelivered("l_returnflag = 'R'")}
SELECT {KEY}, channel, CASE WHEN ROW_NUMBER() OVER (PARTITION BY {KEY} ORDER BY source_file) = 1 THEN 'new' ELSE 'repeat' END AS status FROM led"""

FOLDERS = f"""WITH {ITEMS},
cards AS (SELECT * REPLACE (CASE WHEN l_returnflag = 'R' THEN -amount ELSE amount END AS amount, owner || strftime(txn_date, '_%Y-%m') AS owner) FROM items WHERE l_linestatus = 'F'),
bank AS (SELECT * FROM items WHERE l_linestatus = 'O' AND l_returnflag <> 'R')"""
FEES_DUE = f"""fees AS (SELECT MIN(txn_date) AS txn_date, MIN(txn_date) AS booking_date, '{FEES['label']}' AS description, CAST({FEES['fee']} AS DOUBLE) AS amount, 'fee' AS source_file, owner
  FROM cards GROUP BY owner HAVING MIN(txn_date) > {day(FEES['after'])} AND SUM({money()}) > {FEES['threshold']})"""
MANUAL_ROWS = """SELECT CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE), 'rod ' || o_orderkey, o_totalprice, 'spesa condivisa', 'owner_a' FROM orders WHERE o_orderstatus = 'P'"""
ORACLES["load_from_statements"] = f"""{FOLDERS}, {FEES_DUE},
arrived AS (SELECT {RAW} FROM items WHERE source_file = 'src_P' UNION ALL SELECT {RAW} FROM cards UNION ALL SELECT {RAW} FROM fees UNION ALL SELECT {RAW} FROM bank UNION ALL {MANUAL_ROWS}),
{tag_cte('arrived')} SELECT {TAGGED.replace('source_file, ', '')} FROM led WHERE NOT update_exception"""
ORACLES["stream_statements"] = f"""{FOLDERS},
arrived AS (SELECT {RAW} FROM cards UNION ALL SELECT {RAW} FROM bank
  UNION ALL SELECT {RAW.replace('source_file', "'redelivered' AS source_file")} FROM cards WHERE l_returnflag = 'R'),
{tag_cte('arrived')} SELECT {KEY}, channel, CASE WHEN source_file = 'redelivered' THEN 'repeat' ELSE 'new' END AS status FROM led"""
ORACLES["stream_two_sources"] = f"""WITH {ITEMS}, arrived AS (SELECT {RAW} FROM items WHERE owner = 'owner_a' UNION ALL SELECT {RAW.replace('source_file', "'second' AS source_file")} FROM items),
{tag_cte('arrived')} SELECT {KEY}, source_file, CASE WHEN source_file = 'second' AND owner = 'owner_a' THEN 'repeat' ELSE 'new' END AS status FROM led"""

# --- rule maintenance



def rules_select(**columns) -> str:
    names = RULE_COLS.split(", ")
    return "SELECT " + ", ".join(f"{columns[c]} AS {c}" if c in columns else c for c in names) + " FROM rules"


LAST = "(SELECT MAX(rule_ord) FROM rules)"
ORACLES["rules_insert"] = f"""{RULES} {rules_select()}
UNION ALL SELECT CAST({LAST} + rule_ord AS INTEGER), 'NEW ' || name, 'viaggi', p_name, false, p_size > 25, 0, 0, 0 FROM rules WHERE p_type = 'PROMO'"""
ORACLES["rules_update"] = f"{RULES} " + rules_select(
    classification="CASE WHEN p_type = 'PROMO' THEN 'auto' ELSE classification END", essential="CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE essential END"
)
ORACLES["rules_add_term"] = f"{RULES} " + rules_select(
    descriptions="CASE WHEN p_type IN ('PROMO', 'LARGE') THEN descriptions || '|' || full_term ELSE descriptions END"
)
ONE_LESS = "CASE WHEN p_size > 25 THEN other || '|' || full_term ELSE sku END"
ORACLES["rules_remove_term"] = f"{RULES} " + rules_select(descriptions=f"CASE WHEN p_type IN ('PROMO', 'LARGE') THEN {ONE_LESS} ELSE descriptions END")
ORACLES["rules_rename"] = f"{RULES} " + rules_select(name="CASE WHEN p_type = 'SMALL' THEN name || ' BIS' ELSE name END")
# The name that ECONOMY parts take is handed on from part to part, up to the one after the last.
ORACLES["rules_rename_chain"] = f"{RULES} " + rules_select(name="""CASE p_type WHEN 'SMALL' THEN name || ' TER' WHEN 'LARGE' THEN name || ' BIS'
  WHEN 'ECONOMY' THEN 'LINK ' || (SELECT MAX(p_partkey) + 1 FROM part) ELSE name END""")
ORACLES["rules_remove"] = f"{RULES} {rules_select()} WHERE p_size > 20"
ORACLES["rules_clear_exceptions"] = f"""{RULES} {rules_select()}
WHERE NOT update_exception OR name = (SELECT MIN(name) FROM rules WHERE update_exception)"""
ORACLES["rules_apply_changes"] = f"""{RULES} {rules_select(
    name="CASE WHEN p_type = 'SMALL' THEN name || ' BIS' ELSE name END",
    classification="CASE WHEN p_type = 'MEDIUM' THEN 'salute' ELSE classification END",
    descriptions="CASE p_type WHEN 'LARGE' THEN (CASE WHEN p_size > 25 THEN other ELSE sku END) || '|' || full_term WHEN 'PROMO' THEN descriptions || '|added' ELSE descriptions END",
    web="web OR p_type = 'MEDIUM'",
    essential="CASE WHEN p_type = 'MEDIUM' THEN 2 ELSE essential END")}
WHERE p_type <> 'ECONOMY'
UNION ALL SELECT CAST({LAST} + rule_ord * 10 + 3 AS INTEGER), name, 'salute', 'again', false, false, 0, 0, 0 FROM rules WHERE p_type = 'ECONOMY' AND p_size > 25
UNION ALL SELECT CAST({LAST} + rule_ord * 10 + 1 AS INTEGER), 'NEW ' || name, 'asporto', 'one|two', false, false, 0, 0, 0 FROM rules WHERE p_type = 'STANDARD'"""
