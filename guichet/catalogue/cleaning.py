"""Cleaning steps on text, dates and amounts, and the cleaned datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from guichet import vocabulary as V
from guichet.catalogue import D, MONEY, money, register
from guichet.functions import dates, numbers, text
from guichet.operators import columns, filters
from guichet.operators.ranks import number_rows
from guichet.operators.settle import shuffles_removed
from guichet.plans import datasets
from guichet.plans.star import LINE_KEY, as_raw, line_order, raw_declarations, raw_lines
from guichet.session import shared_folder
from guichet.sources.delimited import scan_clean_csv, scan_delimited, scan_latest
from guichet.sources.files import scan_table, write_csv, write_parquet

_ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_IDS = _ID.split(", ")
# Lines of a file of a snapshot.
SNAPSHOT_ROWS = 500_000


def _lines(spark, sf, *names):
    return scan_table(spark, sf, "lineitem").select(*_IDS, *names)


# Text ----------------------------------------------------------------------------


@register(
    "french_decimals",
    rf"""WITH t AS (SELECT {_ID}, CASE l_linenumber WHEN 6 THEN 'n/a'
      WHEN 7 THEN '1' || chr(160) || '234,5'
      WHEN 5 THEN '1d'
      ELSE regexp_replace(replace(CAST(l_extendedprice AS VARCHAR), '.', ','), '(\d)(\d{{3}}),', '\1 \2,') END AS raw
      FROM lineitem)
    SELECT {_ID}, raw, CASE WHEN raw NOT IN ('n/a', '1d', '1' || chr(160) || '234,5')
      THEN CAST(replace(replace(raw, ',', '.'), ' ', '') AS DOUBLE) END AS amount FROM t""",
)
def _(spark, sf):
    li = _lines(spark, sf, "l_extendedprice")
    spaced = F.regexp_replace(
        F.replace(F.col("l_extendedprice").cast("string"), F.lit("."), F.lit(",")),
        r"(\d)(\d{3}),", "$1 $2,",
    )
    number = F.col("l_linenumber")
    raw = F.when(number == 6, "n/a").when(number == 7, "1\u00a0234,5").when(number == 5, "1d").otherwise(spaced)
    return li.select(*_IDS, raw.alias("raw")).withColumn("amount", numbers.parse_fr_decimal(F.col("raw")))


_SPACE = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


@register(
    "normalized_texts",
    f"""WITH t AS (SELECT doc_id, CASE lang WHEN 'es' THEN ' nan ' ELSE
      chr(160) || '  ' || replace(text, ' ', '  ') || '’' || chr(8195) END AS text FROM documents),
    s AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, '’', ''''),
      '^{_SPACE}|{_SPACE}$', '', 'g'), '{_SPACE}', ' ', 'g') AS text FROM t)
    SELECT doc_id, nullif(text, 'nan') AS text FROM s""",
)
def _(spark, sf):
    docs = scan_table(spark, sf, "documents")
    loose = F.concat(
        F.lit("\u00a0  "), F.replace("text", F.lit(" "), F.lit("  ")), F.lit("’\u2003")
    )
    raw = docs.select("doc_id", F.when(F.col("lang") == "es", " nan ").otherwise(loose).alias("text"))
    return text.normalize_texts(raw)


@register(
    "merged_labels",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '2-HIGH' WHEN '2-HIGH' THEN '3-MEDIUM'
      ELSE o_orderpriority END AS o_orderpriority,
      CASE o_orderstatus WHEN 'F' THEN 'O' ELSE o_orderstatus END AS o_orderstatus FROM orders""",
)
def _(spark, sf):
    orders = scan_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return text.merge_labels(
        orders,
        {
            "o_orderpriority": {"1-URGENT": "2-HIGH", "2-HIGH": "3-MEDIUM"},
            "o_orderstatus": {"F": "O"},
            "absent": {"a": "b"},
        },
    )


@register(
    "capitalized_labels",
    """SELECT p_partkey, upper(p_name[1]) || lower(p_name[2:]) AS p_name,
      upper(p_type[1]) || lower(p_type[2:]) AS p_type FROM part""",
)
def _(spark, sf):
    part = scan_table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return text.map_columns(part, ["p_name", "p_type"], text.capitalize)


@register(
    "financing_classes",
    f"""SELECT {_ID}, CASE l_returnflag WHEN 'R' THEN 'Don' WHEN 'A' THEN 'Prêt' ELSE 'Autre' END AS class
      FROM lineitem""",
)
def _(spark, sf):
    li = _lines(spark, sf, "l_returnflag")
    return li.select(*_IDS, text.financing_class(F.col("l_returnflag"), "R", "A").alias("class"))


@register(
    "short_values",
    r"""WITH t AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN replace(text, ' ', '''') ELSE text END AS text
      FROM documents),
    c AS (SELECT doc_id, CASE WHEN length(text) > 40 THEN text[1:39] || '…' ELSE text END AS cut FROM t),
    e AS (SELECT doc_id, cut, replace(replace(replace(replace(cut, '\', '\\'), chr(10), '\n'), chr(13), '\r'),
      chr(9), '\t') AS shown FROM c)
    SELECT doc_id, CASE WHEN NOT contains(cut, '''') THEN '''' || shown || ''''
      WHEN NOT contains(cut, '"') THEN '"' || shown || '"'
      ELSE '''' || replace(shown, '''', '\''') || '''' END AS short FROM e""",
)
def _(spark, sf):
    docs = scan_table(spark, sf, "documents")
    quotes = F.when(F.col("lang") == "fr", F.replace("text", F.lit(" "), F.lit("'"))).otherwise(F.col("text"))
    return docs.select("doc_id", text.short_value(quotes).alias("short"))


# Dates ---------------------------------------------------------------------------

_DATE_TEXT = """CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%d/%m/%Y')
  WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN '3-MEDIUM' THEN 'bientôt'
  WHEN '4-NOT SPECIFIED' THEN '32/13/2020' END"""


def _dated(spark, sf):
    orders = scan_table(spark, sf, "orders")
    p, d = F.col("o_orderpriority"), F.col("o_orderdate")
    raw = (
        F.when(p == "1-URGENT", F.date_format(d, "dd/MM/yyyy"))
        .when(p == "2-HIGH", F.date_format(d, "yyyy-MM-dd"))
        .when(p == "3-MEDIUM", "bientôt")
        .when(p == "4-NOT SPECIFIED", "32/13/2020")
    )
    return orders.select("o_orderkey", raw.alias("raw"))


@register(
    "parsed_dates",
    f"""SELECT o_orderkey, {_DATE_TEXT} AS raw, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH')
      THEN o_orderdate END AS parsed FROM orders""",
)
def _(spark, sf):
    return _dated(spark, sf).withColumn("parsed", dates.parse_date(F.col("raw")))


@register(
    "date_parts",
    f"""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderdate END AS d
      FROM orders) SELECT o_orderkey, d AS {V.COMMITMENT_DAY}, CAST(year(d) AS INTEGER) AS {V.COMMITMENT_YEAR},
      CAST(month(d) AS INTEGER) AS {V.COMMITMENT_MONTH} FROM t""",
)
def _(spark, sf):
    df = _dated(spark, sf).select("o_orderkey", dates.parse_date(F.col("raw")).alias("parsed"))
    return dates.date_parts(
        df, "parsed", day=V.COMMITMENT_DAY, year=V.COMMITMENT_YEAR, month=V.COMMITMENT_MONTH
    )


@register(
    "period_labels",
    """SELECT event_id, strftime(ts, '%Y-%m') AS month, concat(year(ts), 'Q', quarter(ts)) AS quarter
      FROM events""",
)
def _(spark, sf):
    ts = F.col("ts")
    return scan_table(spark, sf, "events").select(
        "event_id", dates.period_label(ts, "M").alias("month"), dates.period_label(ts, "Q").alias("quarter")
    )


# Numbers -------------------------------------------------------------------------


@register(
    "binary_markers",
    f"""SELECT {_ID}, CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN 'oui' WHEN 3 THEN 'NaN'
        ELSE CAST(l_tax AS VARCHAR) END AS raw,
      CASE WHEN l_linenumber > 3 AND l_tax > 0 THEN 1 ELSE 0 END AS marker FROM lineitem""",
)
def _(spark, sf):
    n = F.col("l_linenumber")
    raw = F.when(n == 2, "oui").when(n == 3, "NaN").when(n > 3, F.col("l_tax").cast("string"))
    df = _lines(spark, sf, "l_tax").select(*_IDS, raw.alias("raw"))
    return df.withColumn("marker", numbers.binarize(F.col("raw")))


@register(
    "grant_ratios",
    f"""WITH t AS (SELECT {_ID}, CASE WHEN l_linenumber > 1 THEN l_extendedprice * l_discount * 12 END AS num,
      l_extendedprice - 20000 AS den FROM lineitem)
    SELECT {_ID}, CASE WHEN den > 0 AND num IS NOT NULL THEN round(least(greatest(num / den, 0), 1), 9) END AS ratio
      FROM t""",
)
def _(spark, sf):
    li = _lines(spark, sf, "l_extendedprice", "l_discount")
    price = F.col("l_extendedprice")
    num = F.when(F.col("l_linenumber") > 1, price * F.col("l_discount") * 12)
    return li.select(*_IDS, F.round(numbers.grant_ratio(num, price - 20000), 9).alias("ratio"))


@register(
    "log_amounts",
    f"""SELECT {_ID}, round(ln(1 + l_extendedprice), 9) AS log_amount, round(exp(l_quantity / 10) - 1, 6) AS amount,
      round(exp(l_quantity / 10 - 1.5) - 1, 6) AS low, round(exp(l_quantity / 10 + 1.5) - 1, 6) AS high
      FROM lineitem""",
)
def _(spark, sf):
    li = _lines(spark, sf, "l_extendedprice", "l_quantity")
    log = F.col("l_quantity") / 10
    span = numbers.prediction_range(log, 1.5)
    return li.select(
        *_IDS,
        F.round(numbers.log_amount(F.col("l_extendedprice")), 9).alias("log_amount"),
        F.round(numbers.invert_log(log), 6).alias("amount"),
        F.round(span["low"], 6).alias("low"),
        F.round(span["high"], 6).alias("high"),
    )


@register(
    "amount_bands",
    f"""WITH t AS (SELECT {_ID}, l_quantity / 10 AS x FROM lineitem)
    SELECT {_ID}, CASE WHEN x <= 1.792 THEN 'Petit (≤ 5 K EUR)' WHEN x <= 2.852 THEN 'Moyen (5 – 16 K EUR)'
      WHEN x <= 5.017 THEN 'Grand (16 – 150 K EUR)' ELSE 'Très grand (> 150 K EUR)' END AS band,
    CASE WHEN x <= 1.5 THEN 'a' WHEN x <= 3 THEN 'b' ELSE 'c' END AS own_band FROM t""",
)
def _(spark, sf):
    x = F.col("l_quantity") / 10
    return _lines(spark, sf, "l_quantity").select(
        *_IDS,
        numbers.amount_band(x).alias("band"),
        numbers.amount_band(x, [1.5, 3.0], ["a", "b", "c"]).alias("own_band"),
    )


@register(
    "amount_labels",
    f"""WITH t AS (SELECT {_ID}, l_extendedprice / 64 AS x, l_extendedprice AS y, l_quantity AS q FROM lineitem)
    SELECT {_ID}, CASE WHEN x < 1000 THEN format('{{:,.0f}} K EUR', x)
        ELSE format('{{:,.1f}} M EUR', x / 1000) END AS label,
      CASE WHEN y = floor(y) THEN replace(format('{{:,}}', CAST(y AS BIGINT)), ',', ' ')
        ELSE replace(replace(format('{{:,.2f}}', y), ',', ' '), '.', ',') END AS amount_fr,
      replace(format('{{:,}}', CAST(q AS BIGINT)), ',', ' ') AS quantity_fr FROM t""",
)
def _(spark, sf):
    return _lines(spark, sf, "l_extendedprice", "l_quantity").select(
        *_IDS,
        numbers.amount_label(F.col("l_extendedprice") / 64).alias("label"),
        numbers.format_number_fr(F.col("l_extendedprice")).alias("amount_fr"),
        numbers.format_number_fr(F.col("l_quantity")).alias("quantity_fr"),
    )


@register(
    "rounded_and_scaled",
    f"""SELECT {_ID}, CAST(round_even(CAST(l_quantity / 8 AS DECIMAL(18,3)), 2) AS DOUBLE) AS half_even,
      round(l_extendedprice / 1000, 5) AS millions, round(l_extendedprice * 1000, 2) AS euros FROM lineitem""",
)
def _(spark, sf):
    price = F.col("l_extendedprice")
    return _lines(spark, sf, "l_extendedprice", "l_quantity").select(
        *_IDS,
        numbers.round_half_even(F.col("l_quantity") / 8, 2).alias("half_even"),
        F.round(numbers.to_millions(price), 5).alias("millions"),
        F.round(numbers.keur_to_eur(price), 2).alias("euros"),
    )


@register(
    "coerced_integers",
    f"""SELECT {_ID}, CAST(trunc(l_extendedprice) AS INTEGER) AS whole,
      CAST(year(l_shipdate) AS INTEGER) AS strict FROM lineitem WHERE l_linenumber <> 4""",
)
def _(spark, sf):
    li = _lines(spark, sf, "l_extendedprice", "l_shipdate")
    raw = F.when(F.col("l_linenumber") == 4, "inconnu").otherwise(F.col("l_extendedprice").cast("string"))
    strict = numbers.require_int(F.date_format("l_shipdate", "yyyy"), "year").alias("strict")
    return filters.coerce_int_or_drop(li.select(*_IDS, raw.alias("whole"), strict), "whole")


@register(
    "markers_as_categories",
    f"SELECT {_ID}, coalesce(CAST(nullif(l_tax, 0) AS VARCHAR), 'nan') AS tax FROM lineitem",
)
def _(spark, sf):
    tax = F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("tax")
    return numbers.marker_as_category(_lines(spark, sf, "l_tax").select(*_IDS, tax), ["tax"])


# Columns -------------------------------------------------------------------------


@register(
    "columns_chosen_by_name",
    """SELECT l_orderkey AS project, l_extendedprice AS "Engagements (K EUR)", l_returnflag AS "Type de financement"
      FROM lineitem""",
)
def _(spark, sf):
    li = scan_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias(" project "),
        F.col("l_extendedprice").alias("Engagements (K EUR)"),
        F.col("l_tax").alias("Engagements (K USD)"),
        F.col("l_partkey").alias("Code agence"),
        F.col("l_suppkey").alias("Numero de projet"),
        F.col("l_returnflag").alias("Type de financement"),
        F.col("l_linestatus").alias("Agence.1"),
    )
    df = columns.strip_headers(li)
    df = columns.drop_columns_containing(df, V.DOLLAR_UNIT_FRAGMENT)
    df = columns.drop_columns_matching(df, V.CODE_PATTERN)
    df = columns.drop_if_present(df, V.IDENTIFIERS)
    return columns.keep_if_present(df, ["project", V.COMMITTED, V.FINANCING_TYPE, V.CHANNEL])


@register(
    "sparse_columns_pruned",
    f"SELECT {_ID}, CASE WHEN l_linenumber > 1 THEN l_tax END AS kept, "
    "CASE WHEN l_tax > 0.07 AND l_linenumber > 6 THEN 1 END AS protected FROM lineitem",
)
def _(spark, sf):
    rare = (F.col("l_tax") > 0.07) & (F.col("l_linenumber") > 6)
    df = _lines(spark, sf, "l_tax").select(
        *_IDS,
        F.when(F.col("l_linenumber") > 1, F.col("l_tax")).alias("kept"),
        F.when(rare, 1).alias("protected"),
        F.when(rare, 2).alias("pruned"),
    )
    return columns.prune_sparse_columns(df, 90.0, protect=["protected"])


# Files ---------------------------------------------------------------------------


@register("delimited_round_trip", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source FROM documents")
def _(spark, sf):
    folder = shared_folder(spark)
    docs = scan_table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    docs.write.options(header=True, sep=";", quote='"', escape='"').csv(folder)
    return scan_delimited(spark, folder, row_ord=None)


@register("clean_csv_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def _(spark, sf):
    folder = shared_folder(spark)
    talks = scan_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    write_csv(talks, folder)
    return scan_clean_csv(spark, folder, talks.schema)


@register("parquet_round_trip", "SELECT page_id, url, html FROM pages")
def _(spark, sf):
    folder = shared_folder(spark)
    write_parquet(scan_table(spark, sf, "pages"), folder)
    return spark.read.parquet(folder)


@register(
    "delimited_with_line_breaks",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang || chr(10) || '"' || coalesce(text, '') || '";' || chr(13) || chr(10) || source AS text,
      row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents""",
)
def _(spark, sf):
    """Every text has quoted breaks, quotes and separators; rows come back in file order."""
    folder = shared_folder(spark)
    broken = F.concat("lang", F.lit('\n"'), F.coalesce("text", F.lit("")), F.lit('";\r\n'), "source")
    docs = scan_table(spark, sf, "documents").select("doc_id", broken.alias("text"))
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.write.options(header=True, sep=";", quote='"', escape='"').csv(folder)
    numbered, _ = number_rows(scan_delimited(spark, folder), [F.col("row_ord")])
    return numbered.drop("row_ord")


# Datasets ------------------------------------------------------------------------


def _snapshot(lines, path):
    """The raw declarations as delimited text, in the order of their lines.

    Lines are put in order before they become text, which is longer. The text is packed, in files short
    enough to be read by a task each.
    """
    ordered = lines.repartitionByRange(*LINE_KEY).sortWithinPartitions(*LINE_KEY)
    packed = {"compression": "gzip", "maxRecordsPerFile": SNAPSHOT_ROWS}
    with shuffles_removed(lines.sparkSession):
        as_raw(ordered).write.options(header=True, sep=";", quote='"', escape='"', **packed).csv(path)


def _keys_as_numbers(df):
    return text.map_columns(df, LINE_KEY, lambda c: c.cast("long"))


_COUNTRY = "CASE country WHEN 'NATION_7' THEN 'Turquie' ELSE country END"
_CHANNEL = "CASE channel WHEN 'BUILDING' THEN 'Réseau' WHEN 'HOUSEHOLD' THEN 'ONG internationale' ELSE channel END"
_TYPE = "CASE financing WHEN 'R' THEN 'Dons' WHEN 'A' THEN 'Prêt' ELSE 'Annulation' END"
_ORIGIN = "upper(priority[1]) || lower(priority[2:])"


_EXPLORE = (
    D + f""", r AS (SELECT *, CASE WHEN quantity < 50 THEN project END AS key, round(granted, 4) AS g FROM d),
    u AS (SELECT * FROM r QUALIFY row_number() OVER (
      PARTITION BY signed, committed, key ORDER BY project, line, part, supplier) = 1),
    p AS (SELECT *, CASE WHEN key IS NOT NULL THEN
          round(CAST(sum(CAST(committed AS DECIMAL(28,6))) OVER (PARTITION BY key) AS DOUBLE), 2) END AS c_sum,
        CASE WHEN key IS NOT NULL THEN
          round(CAST(sum(CAST(g AS DECIMAL(28,6))) OVER (PARTITION BY key) AS DOUBLE), 4) END AS g_sum
      FROM u QUALIFY row_number() OVER (
        PARTITION BY key ORDER BY signed NULLS LAST, project, line, part, supplier) = 1)
    SELECT project, line, part, supplier, c_sum AS "{V.COMMITTED}", g_sum AS "{V.GRANT_EQUIVALENT}",
      g_sum AS "{V.PAID}", agency AS "{V.AGENCY}", {_COUNTRY} AS "{V.COUNTRY}", region AS "{V.REGION}",
      sector AS "{V.SECTOR}", {_TYPE} AS "{V.FINANCING_TYPE}", {_CHANNEL} AS "{V.CHANNEL}",
      {_ORIGIN} AS "{V.MOBILISED_ORIGIN}", CAST(marker > 0 AS INTEGER) AS "Genre", signed AS {V.COMMITMENT_DAY},
      CAST(year(signed) AS INTEGER) AS {V.COMMITMENT_YEAR}, CAST(month(signed) AS INTEGER) AS {V.COMMITMENT_MONTH}
    FROM p"""
)


def _rounded(df):
    rounded = {V.COMMITTED: 2, V.GRANT_EQUIVALENT: 4, V.PAID: 4}
    return df.select(*[F.round(text.quoted(c), rounded[c]).alias(c) if c in rounded else text.quoted(c) for c in df.columns])


@register("explore_dataset", _EXPLORE)
def _(spark, sf):
    return _rounded(datasets.build_explore_dataset(raw_declarations(spark, sf), line_order(), scale=MONEY))


@register("explore_dataset_from_file", _EXPLORE)
def _(spark, sf):
    folder = shared_folder(spark)
    _snapshot(raw_lines(spark, sf), folder)
    return _keys_as_numbers(_rounded(datasets.build_explore_dataset(scan_delimited(spark, folder))))


@register(
    "model_dataset",
    D + f"""SELECT project, line, part, supplier, CAST(round(committed, 2) AS DECIMAL(18,2)) AS committed,
      year AS "{V.DECLARATION_YEAR}", {_COUNTRY} AS "{V.COUNTRY}", {_TYPE} AS "{V.FINANCING_TYPE}",
      CAST(marker > 0 AS INTEGER) AS "Genre",
      CASE financing WHEN 'R' THEN 'Don' WHEN 'A' THEN 'Prêt' ELSE 'Autre' END AS {V.FINANCING_CLASS},
      CAST(month(signed) AS INTEGER) AS {V.COMMITMENT_MONTH},
      CASE WHEN committed > 0 THEN round(least(greatest(round(granted, 4) / committed, 0), 1), 9) END
        AS {V.GRANT_RATIO} FROM d""",
)
def _(spark, sf):
    raw = raw_declarations(spark, sf)
    # This dataset takes amounts with a decimal point, as they are.
    plain = text.map_columns(
        raw, [V.COMMITTED, V.GRANT_EQUIVALENT], lambda c: F.replace(c, F.lit(","), F.lit("."))
    )
    df = datasets.build_model_dataset(plain, date_formats=V.DAY_FIRST_FORMATS)
    return df.select(
        *LINE_KEY,
        text.quoted(V.COMMITTED).cast("decimal(18,2)").alias("committed"),
        *[text.quoted(c) for c in (
            V.DECLARATION_YEAR, V.COUNTRY, V.FINANCING_TYPE, "Genre", V.FINANCING_CLASS, V.COMMITMENT_MONTH)],
        F.round(V.GRANT_RATIO, 9).alias(V.GRANT_RATIO),
    )


_HOURLY = (
    D + f"""SELECT project, line, part, supplier, agency AS "{V.AGENCY}", {_TYPE} AS "{V.FINANCING_TYPE}",
      CASE country WHEN 'NATION_7' THEN 'Türkiye' ELSE country END AS "{V.COUNTRY}", region AS "{V.REGION}",
      sector AS "{V.SECTOR}", year AS "{V.DECLARATION_YEAR}", round(ln(1 + round(granted, 4)), 9) AS {V.LOG_PAID}
      FROM d WHERE round(granted, 4) > 0"""
)


def _hourly(raw):
    df = datasets.build_hourly_features(datasets.build_hourly_clean(raw), keep=LINE_KEY)
    return df.withColumn(V.LOG_PAID, F.round(V.LOG_PAID, 9))


@register("hourly_features", _HOURLY)
def _(spark, sf):
    return _hourly(raw_declarations(spark, sf))


@register("hourly_features_from_newest_snapshot", _HOURLY)
def _(spark, sf):
    """The snapshot of an hour before holds other lines."""
    folder, lines = shared_folder(spark), raw_lines(spark, sf)
    _snapshot(lines.where("line = 2"), f"{folder}/apd_2024-01-31_23.csv")
    _snapshot(lines, f"{folder}/apd_2024-02-01_00.csv")
    return _keys_as_numbers(_hourly(scan_latest(spark, folder)))


@register(
    "hourly_clean_totals",
    D + f"""SELECT year AS "{V.DECLARATION_YEAR}", count(*) AS n, {money('round(granted, 4)', 4)} AS paid
      FROM d WHERE granted > 0 GROUP BY year""",
)
def _(spark, sf):
    clean = datasets.build_hourly_clean(raw_declarations(spark, sf))
    return clean.groupBy(text.quoted(V.DECLARATION_YEAR)).agg(
        F.count(F.lit(1)).alias("n"), F.round(numbers.exact_sum(text.quoted(V.PAID)), 4).alias("paid")
    )


