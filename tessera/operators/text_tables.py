"""Tables that a page's text declares: the page is cut into tables, and each one's rows are read under its own header.

A table opens at a line that heads a column of compounds, unless a header is open already. Its header goes on over lines
that name a compound column, a metric or a count, up to the first row; its rows go on up to a stop or the next table.
A line with several printed labels is several rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.functions.headers import METRIC, count_role, distinct_fields, field_name, metric_signs, metric_text, unit_of
from tessera.functions.identifiers import PREFIX, PRINTED, identifier_key
from tessera.functions.structures import TABLE_MARKER
from tessera.functions.text import is_value, only_values, value_tokens
from tessera.sources.scratch import cut, spread

#: What opens a table's header, what ends a table, how a row begins, and labels that split a line.
HEADER = r"(?i)(?:Compound|Cmpd|Cpd|Example)\s*(?:No\.?|ID|#)|化合物编号|实施例编号|\bNo\.(?=\s|\||$)|\bID\b|\b[A-Za-z]-#"
STOP = r"(?i)^(?:\*|NA:|N/A:|Note:|以上数据|实验目的|实验方法|计算公式|权利要求|What\s+is\s+claimed|EQUIVALENTS|\[\d{4,}\])"
CONTROL = r"(?:Ref\.?\s*\d+|Reference(?:\s+\S+)?|Vehicle|DMSO|Control|Nab[-\s]?paclitaxel|Paclitaxel)"
ROW = rf"(?i)^((?:{PREFIX})?{PRINTED}|{CONTROL})(?=\s|\||$)\s*(.*)$"
LABELLED = rf"(?i)(?!^)(?<!\w)(?={PREFIX}{PRINTED}(?=\s|$))|(?!^)(?<![\w-])(?=(?:[A-Za-z]{{1,12}}-\d+(?:-\d+)*|\d+-\d+)\s+[A-G](?=\s|$))"
#: What every header, and every label behind a line's beginning, has something of.
HEADER_SIGN = r"[nN][oO]|[iI][dD]|#|编号"
LABEL_SIGN = r"(?s).(?:[cC][oOmMpP]|[eE][xX]|实施|化合)|-[0-9]"
#: How grades are declared.
DECLARATION = r"(?iU)letter\s+codes?\s+for\s+(.{1,80}?)\s+include\s*:"
INTRODUCTION = r"(?iU)letter\s+codes?\s+for\b"
DEFINITION = r"(?i)\b([A-G])\s*\(\s*([^)]{1,1000})\)"
MOLAR = r"(?<![A-Za-z])[fpnumµμ]?M(?![A-Za-z])"
MOST_DECLARATIONS = 32
SEPARATOR = r"\t|\|"


def lines_of(pages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line, part, t): the lines with text, those with several labels in parts."""
    lines = pages.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("line", "t"))
    parts = F.when(F.col("t").rlike(LABEL_SIGN), F.split(F.regexp_replace("t", LABELLED, "\n"), "\n")).otherwise(F.array("t"))
    return lines.select(*keys, "line", F.posexplode(parts).alias("part", "t")).withColumn("t", F.trim("t")).where("t <> ''")


def segments(pages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, segment, line, part, t, role, metric): the lines of each page's tables, numbered from 1; role: head, row or other.

    A head stands before its table's first row, and metric tells whether a line up to there names one; lines behind a table's stop, and before the first table, are left out.
    """
    lines = lines_of(spread(pages, *keys), keys, text).withColumns({"opens": F.col("t").rlike(HEADER_SIGN) & F.col("t").rlike(HEADER), "stop": F.col("t").rlike(STOP)})
    lines = lines.withColumn("row", F.col("t").rlike(ROW) & ~F.col("opens") & ~metric_signs(F.col("t"))["whole"])
    order = Window.partitionBy(*keys).orderBy("line", "part")
    event = F.when(F.col("stop"), "stop").when(F.col("opens"), "open").when(F.col("row"), "row")
    before = F.last(event, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.col("opens") & ~F.col("stop") & F.coalesce(before != "open", F.lit(True))
    lines = lines.withColumn("starts", starts)
    lines = lines.withColumn("segment", F.sum(F.col("starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("segment > 0")
    own = Window.partitionBy(*keys, "segment").orderBy("line", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumns({"stopped": F.max("stop").over(own), "begun": F.max("row").over(own)}).where("not stopped")
    lines = lines.withColumn("metric", ~F.col("begun") & metric_signs(F.col("t"))["metric"])
    role = F.when(~F.col("begun") & (F.col("opens") | F.col("metric") | count_role(F.col("t")).isNotNull()), "head").when(F.col("row"), "row").otherwise("other")
    return lines.select(*keys, "segment", "line", "part", "t", role.alias("role"), F.col("opens"), F.col("metric"))


def table_headers(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, segment, header, counts, endpoints, names, units) of ``segments``: each table's header as one text, and the field of each of its columns.

    Bars or tabs separate the columns, the first one is that of the labels; without them each metric is a column. A header without a metric gives none.
    """
    heads = lines.where("role = 'head'")
    opened = F.when(F.col("opens"), F.regexp_extract("t", rf"({HEADER}).*$", 0)).otherwise(F.col("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "part", opened.alias("t")))), lambda x: x["t"]), " ")
    found = heads.groupBy(*keys, "segment").agg(joined.alias("header"), F.max("metric").alias("metric")).where("metric")
    found = cut(found.select(*keys, "segment", "header"), "headers")  # read for its distinct headers, and again with what they say
    return N.parsed(found, "header", "read", header_columns).select(*keys, "segment", "header", "read.*")


def header_columns(header):
    """(counts, endpoints, names, units) of a header: what its columns of counts count, its metrics, the field of each column, and the units in its
    brackets. Tables share headers."""
    barred = header.rlike(SEPARATOR)
    positions = F.transform(cells_behind(header), lambda x, i: field_name(x, i + 1))
    listed = F.transform(F.regexp_extract_all(metric_text(header), F.lit(METRIC), F.lit(0)), lambda x, i: field_name(x, i + 1))
    counted = F.when(barred, F.transform(cells_behind(header), count_role))
    bracketed = F.transform(F.regexp_extract_all(metric_text(header), F.lit(r"\(([^()]*)\)"), F.lit(1)), unit_of)
    units = F.array_distinct(F.transform(F.filter(bracketed, lambda u: u.isNotNull()), lambda u: F.translate(u, "µμ", "uu")))
    return F.struct(counted.alias("counts"), endpoints(header).alias("endpoints"), N.let(F.when(barred, positions).otherwise(listed), distinct_fields).alias("names"), units.alias("units"))


def cells_behind(text):
    """The cells behind the first of a line with bars or tabs."""
    parts = F.split(F.regexp_replace(text, r"^\|+|\|+$", ""), SEPARATOR, -1)
    return F.transform(N.let(parts, lambda p: F.slice(p, F.lit(2), F.size(p))), lambda x: F.trim(x))


def table_rows(pages: DataFrame, keys: list[str], text: str, legends: DataFrame | None = None) -> DataFrame:
    """(keys, segment, line, part, label, cpd, values, legend, needs_review) of every table of each page; pages without a header or a metric in it give none.

    values maps the header's columns to the row's cells. Cells between bars or tabs are taken by position; without them
    the whole tail must be values, and as many as the header has metrics, or they are withheld for review. A line of prose
    is no row. Nothing is inferred from an identifier's number. Cells beyond the header's columns are unknown fields, and are reviewed. Columns of
    counts are no measurements.
    With ``legends`` (``grade_legends`` by some of the keys) the grades of a table with that one metric are explained; issues are reviewed.
    """
    lines = cut(segments(pages, keys, text), "lines")
    headers = table_headers(lines, keys)
    legend, troubled = F.lit(None).cast("map<string,string>"), F.lit(False)
    if legends is not None:
        shared = [k for k in keys if k in legends.columns]
        headers = headers.join(legends.select(*shared, "metric", "grades", "issues", molar_units(F.map_values("grades")).alias("meant")), shared, "left")
        owns = (F.size("endpoints") == 1) & (F.get("endpoints", F.lit(0)) == F.col("metric"))
        differs = owns & (F.size("meant") > 0) & (F.size("units") > 0) & (F.size(F.array_except("meant", "units")) + F.size(F.array_except("units", "meant")) > 0)
        troubled = F.coalesce((F.size("issues") > 0) | ~owns | differs, F.lit(False))
        legend = F.when(owns & ~troubled, F.col("grades"))
    headers = headers.select(*keys, "segment", "names", "counts", legend.alias("legend"), troubled.alias("troubled"))
    placed = F.col("t").rlike(SEPARATOR)
    rows = lines.where("role = 'row'").where(placed | only_values(F.regexp_extract("t", ROW, 2)))
    rows = spread(rows.join(headers, [*keys, "segment"]), *keys)
    found = rows.select(*keys, "segment", "line", "part", "names", "counts", "legend", "troubled", F.regexp_extract("t", ROW, 1).alias("label"), placed.alias("placed"), F.when(placed, cells_behind(F.col("t"))).otherwise(value_tokens(F.regexp_extract("t", ROW, 2))).alias("found"))
    wrong = ~F.col("placed") & (F.size("found") != F.size("names"))
    more = F.transform(F.slice("found", F.size("names") + 1, F.greatest(F.size("found") - F.size("names"), F.lit(0))), lambda x, i: F.concat(F.lit("Unknown activity field "), (F.size("names") + i + 1).cast("string"), F.lit(" (unit unknown)")))
    found = found.withColumn("columns", F.concat("names", more)).withColumn("wrong", wrong)
    value = lambda i: F.when(F.col("wrong"), "").otherwise(F.coalesce(F.get("found", i), F.lit("")))
    counted = lambda i: F.coalesce(F.get("counts", i).isNotNull(), F.lit(False))
    cells = F.filter(F.transform("columns", lambda k, i: F.struct(k.alias("key"), value(i).alias("value"), counted(i).alias("counted"))), lambda c: ~c["counted"])
    found = found.withColumn("cells", cells)
    unsure = F.col("wrong") | F.col("troubled") | F.exists("cells", lambda c: ~is_value(c["value"]) | F.lower(c["key"]).contains("unknown"))
    found = found.withColumn("key", identifier_key(F.col("label")))
    values = F.map_from_entries(F.transform("cells", lambda c: F.struct(c["key"], c["value"])))
    return found.select(*keys, "segment", "line", "part", "label", F.when(F.col("key") != "", F.concat(F.lit("Compound "), F.col("key"))).otherwise(F.col("label")).alias("cpd"), values.alias("values"), "legend", unsure.alias("needs_review"))


def endpoints(header):
    """The metrics that a text names, without brackets, in small letters."""
    return F.transform(F.regexp_extract_all(metric_text(header), F.lit(METRIC), F.lit(0)), lambda x: F.lower(F.trim(F.substring_index(x, "(", 1))))


def molar_units(meanings):
    found = F.flatten(F.transform(meanings, lambda m: F.regexp_extract_all(m, F.lit(MOLAR), F.lit(0))))
    return F.array_distinct(F.transform(found, lambda u: F.translate(u, "µμ", "uu")))


def grade_legends(pages: DataFrame, keys: list[str], page: str, text: str) -> DataFrame:
    """(keys, metric, grades, issues): what a document's pages say that grades mean, such as "letter codes for IC50 include: A (<10 nM), B (more)".

    All declarations of a document count. They must name one metric, define two grades at least, and agree literally where they define one
    again; their molar units must be the same. A departure is an issue, and a legend with issues explains nothing. Grades are never
    turned into numbers. A declaration ends at the next one, or where a table is captioned.
    """
    source = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+", " ")
    rows = spread(pages, *keys).select(*keys, F.col(page).alias("page"), source.alias("s")).where(F.col("s").rlike(INTRODUCTION))
    labels, tails = F.regexp_extract_all("s", F.lit(DECLARATION), F.lit(1)), F.split("s", DECLARATION, -1)
    said = rows.select(*keys, "page", (F.regexp_count("s", F.lit(INTRODUCTION)) != F.size(labels)).alias("other_form"), F.posexplode_outer(F.transform(labels, lambda l, i: F.struct(F.trim(l).alias("label"), F.get(F.split(F.get(tails, i + 1), f"(?iU){TABLE_MARKER}", 2), F.lit(0)).alias("tail")))).alias("i", "d"))
    pairs = F.zip_with(F.regexp_extract_all("d.tail", F.lit(DEFINITION), F.lit(1)), F.regexp_extract_all("d.tail", F.lit(DEFINITION), F.lit(2)), lambda g, m: F.struct(F.upper(g).alias("grade"), F.trim(m).alias("meaning")))
    read = said.select(*keys, "page", "i", "other_form", endpoints(F.col("d.label")).alias("names"), pairs.alias("pairs"))
    thin = F.col("i").isNotNull() & ((F.size("names") == 0) | (F.size("pairs") < 2))
    whole = read.groupBy(*keys).agg(
        F.min(F.when(F.col("i").isNotNull(), F.struct("page", "i", "names"))).alias("first"),
        F.count_distinct("names").alias("n_names"),
        F.max(F.col("other_form") | thin).alias("unsupported"),
        F.count("i").alias("n"),
    )
    defined = read.select(*keys, F.explode("pairs").alias("p")).select(*keys, "p.grade", "p.meaning").distinct()
    by_grade = defined.groupBy(*keys, "grade").agg(F.count("*").alias("n"), F.min("meaning").alias("meaning"))
    grades = by_grade.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("grade", "meaning")))).alias("grades"), F.max(F.col("n") > 1).alias("differ"))
    joined = whole.join(grades, keys, "left")
    issue = lambda test, name: F.when(F.coalesce(test, F.lit(False)), name)
    issues = F.array_compact(F.array(issue(F.col("unsupported") | (F.col("n") > MOST_DECLARATIONS), "unsupported_declaration"), issue(F.col("n_names") > 1, "conflicting_endpoints"), issue(F.col("differ"), "conflicting_definitions"), issue(F.size(molar_units(F.map_values("grades"))) > 1, "conflicting_units")))
    return joined.select(*keys, F.get("first.names", F.lit(0)).alias("metric"), "grades", issues.alias("issues"))
