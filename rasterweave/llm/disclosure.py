"""Personal data: patterns, and information-theoretic sanitisation of what gives them away.  DataFrame functions only.

Patterns.  Matches of a kind are leftmost and do not overlap each other; what fails the kind's check (a part over 255, Luhn, the number of
digits) is no span, and is not tried again.  A text's matches and the gaps between them are taken in one go; where they lie is a running
sum over one row a match, so a text with any number of matches costs in proportion.

Disclosure.  A protected entity is a value that a pattern found (letters in lower case).  Near its places, up to ``reach``
characters on either side, stand the terms that may reveal it.  With N documents, n(e) of them with the entity, n(t) with the term anywhere,
and n(e,t) with the term near the entity, the entity holds IC = log2(N / n(e)) bits, and a term tells
PMI = log2(N n(e,t) / (n(e) n(t))) of them.  disclosure = PMI / IC is 1 for a term that occurs near the entity only, and 0 for one
that is independent of it.  Terms of at least ``least_docs`` documents n(e,t) whose disclosure is ``generalise`` or more become spans beside the
entity: from ``remove`` on they are removed, below it they are replaced by their class (number, name, word).  Documents without an entity have no spans.

Where the rows meet: statistics are sums by entity and term, partly added before the shuffle; what a document gets back is keyed by its row,
never by its id.

Edge cases: null texts are empty; rows of one id are documents of their own; a term that overlaps a pattern's span is none of its own; an
entity in every document has no information to disclose; words cut by the reach's end, or joined to an entity, are no terms; nearness ends at
the next match of the same kind; repeated rows count as often; no rows give no rows; further columns pass through ``sanitise`` in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
# Runs are taken whole (possessive), and a match starts where its run does or where the last match ended: as the plain patterns, in linear time.
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_TERM = 3  # characters
TOGETHER = 64  # spans of a text that are put in from one part of it


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _matches(kind: str, text: Column, reach: int) -> Column:
    """(kind, no, gap before it, value, what stands before and after) of each match."""
    found, no = F.regexp_extract_all(text, F.lit(PATTERN[kind]), F.lit(0)), KINDS.index(kind)
    if kind in ("email", "phone"):
        found = F.when(F.contains(text, F.lit("@" if kind == "email" else "+")), found).otherwise(_empty("string"))
    both = F.struct(found.alias("found"), F.lit(no).alias("kind"))

    def each(b: Column) -> Column:
        gaps = F.split(text, PATTERN[kind], -1)
        one = F.transform(F.arrays_zip(b["found"].alias("value"), F.slice(gaps, 1, F.size(b["found"])).alias("gap"), F.slice(gaps, 2, F.size(b["found"])).alias("next")), lambda z, i: _match(z, i, no, reach))
        return F.when(F.size(b["found"]) > 0, one).otherwise(_empty(MATCH))

    return F.transform(F.array(both), each)[0]


MATCH = "struct<kind: int, no: int, gap: int, value: string, before: string, after: string>"


def _match(z: Column, i: Column, no: int, reach: int) -> Column:
    before = F.when(F.length(z["gap"]) <= reach, F.concat(F.lit(" "), z["gap"])).otherwise(F.substring(z["gap"], -(reach + 1), reach + 1))
    after = F.when(F.length(z["next"]) <= reach, F.concat(z["next"], F.lit(" "))).otherwise(F.substring(z["next"], 1, reach + 1))
    return F.struct(F.lit(no).alias("kind"), i.alias("no"), F.length(z["gap"]).alias("gap"), z["value"].alias("value"), before.alias("before"), after.alias("after"))


def _sound(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    ip = value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    card = n.between(14, 19) & F.call_function("luhn_check", digits)
    return F.when(kind == 1, ip).when(kind == 2, card).when(kind == 3, n.between(10, 15)).otherwise(True)


def _terms(context: Column, at: Column) -> Column:
    """(term, start, end) of the whole words of a bounded context that begins at code point ``at``."""
    words, gaps = F.regexp_extract_all(context, F.lit(WORD), F.lit(0)), F.split(context, WORD, -1)
    length = lambda xs, n: F.aggregate(F.slice(xs, 1, n), F.lit(0), lambda a, x: a + F.length(x))
    placed = F.transform(words, lambda w, i: F.struct(F.translate(w, UPPER, LOWER).alias("term"), (at + length(gaps, i + 1) + length(words, i)).alias("start"), F.length(w).alias("n"), (F.length(F.get(gaps, i)) > 0).alias("begins"), (F.length(F.get(gaps, i + 1)) > 0).alias("ends")))
    whole = F.filter(placed, lambda t: t["begins"] & t["ends"] & (t["n"] >= LEAST_TERM))
    return F.transform(whole, lambda t: F.struct(t["term"].alias("term"), t["start"].alias("start"), (t["start"] + t["n"]).alias("end")))


def found_spans(documents: DataFrame, keep: list[str], text_col: str = "text", reach: int = 64) -> tuple[DataFrame, DataFrame]:
    """(a row a document: row, the kept columns; a row a sound match: row, kind, start, end, value, before, after).

    The row number is drawn once, in the table that is written here."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), text.alias("text"))
    rows = rows.select("row", "kept", F.concat(*[_matches(k, F.col("text"), reach) for k in KINDS]).alias("matches"))
    rows = materialize(rows, "disclosure-rows")
    each = rows.select("row", F.explode("matches").alias("m")).select("row", "m.*")
    line = Window.partitionBy("row", "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("value")).over(line).cast("int")
    each = each.withColumn("end", end).where(_sound(F.col("kind"), F.col("value")))
    spans = each.select("row", "kind", (F.col("end") - F.length("value")).alias("start"), "end", F.translate("value", UPPER, LOWER).alias("value"), "before", "after")
    return rows.select("row", "kept"), materialize(spans, "disclosure-spans")


def document_counts(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """term, n_term: documents that hold it, over whole texts."""
    low = F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), UPPER, LOWER)
    words = documents.select(F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))


def revealing(documents: DataFrame, rows: DataFrame, spans: DataFrame, *, text_col: str = "text", least_docs: int = 3, generalise: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(entity, term, n_entity, n_term, n_both, disclosure of the terms that reveal; row, entity, term, start, end of all terms near entities)."""
    entity = F.struct("kind", "value").alias("entity")
    ahead = _terms(F.col("before"), F.col("start") - F.length("before"))
    behind = _terms(F.col("after"), F.col("end"))
    near = materialize(spans.select("row", entity, F.explode(F.concat(ahead, behind)).alias("t")).select("row", "entity", "t.*"), "disclosure-near")
    docs_of = lambda df, *by: df.select("row", *by).distinct().groupBy(*by)
    both = docs_of(near, "entity", "term").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= least_docs)
    entities = docs_of(spans.select("row", entity), "entity").agg(F.count(F.lit(1)).alias("n_entity"))
    total = rows.count()
    told = both.join(entities, "entity").join(document_counts(documents, text_col), "term")
    bits = F.log2(F.lit(float(total)) / F.col("n_entity"))
    pmi = bits + F.log2(F.col("n_both") / F.col("n_term"))
    told = told.where(F.col("n_entity") < total).withColumn("disclosure", F.round(pmi / bits, 9)).where(F.col("disclosure") >= generalise)
    return materialize(told, "disclosure-terms"), near


def all_spans(documents: DataFrame, keep: list[str], *, text_col: str = "text", reach: int = 64, least_docs: int = 3, generalise: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(row, kept columns; row, kind, start, end, disclosure): the patterns' spans, and beside them those of revealing terms."""
    rows, spans = found_spans(documents, keep, text_col, reach)
    told, near = revealing(documents, rows, spans, text_col=text_col, least_docs=least_docs, generalise=generalise)
    hits = near.join(told.select("entity", "term", "disclosure"), ["entity", "term"]).groupBy("row", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    hits = hits.select("row", F.lit(len(KINDS)).alias("kind"), "start", "end", "disclosure")
    line = spans.select("row", "kind", "start", "end", F.lit(None).cast("double").alias("disclosure")).union(hits)
    base = F.col("kind") < len(KINDS)
    order = Window.partitionBy("row").orderBy("start", "kind")
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    clear = (F.coalesce(before, F.lit(0)) <= F.col("start")) & F.coalesce(after >= F.col("end"), F.lit(True))
    return rows, line.withColumn("clear", base | clear).where("clear").drop("clear")


def sanitise(documents: DataFrame, text_col: str = "text", *, remove: float = 0.95, **options) -> DataFrame:
    """The documents with spans put out: patterns and less telling terms become their class, the most telling terms go.

    Spans that overlap are put out as one, under the first one's class."""
    names = documents.columns
    rows, spans = all_spans(documents, names, text_col=text_col, **options)
    order = Window.partitionBy("row").orderBy("start", "kind", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum(F.when(F.col("start") < reached, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    each = spans.withColumn("reached", reached).withColumn("group", group).groupBy("row", "group").agg(F.min(F.struct("start", "kind", "disclosure")).alias("s"), F.max("end").alias("end"))
    cuts = each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s.start", "end", "s.kind", "s.disclosure"))).alias("cuts"))
    text = F.coalesce(F.col(f"kept.`{text_col}`"), F.lit(""))
    n = F.size("cuts")

    def mark(cut: Column, was: Column) -> Column:
        kind = F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit("")), cut["kind"] + 1)
        of_word = F.when(was.rlike(r"^[0-9]+$"), "[NUMBER]").when(was.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
        return F.when(cut["kind"] < len(KINDS), kind).when(cut["disclosure"] >= remove, "").otherwise(of_word)

    def part(b: Column) -> Column:
        """TOGETHER spans and what stands before each, from one stretch of the text; the last stretch goes to the text's end."""
        mine = F.slice("cuts", b * TOGETHER + 1, TOGETHER)
        first = F.when(b == 0, 0).otherwise(F.get("cuts", b * TOGETHER - 1)["end"])
        last = F.element_at(mine, -1)["end"]
        stretch = F.substring(text, first + 1, last - first)
        done = F.transform(mine, lambda c, i: F.concat(_between(stretch, F.when(i == 0, first).otherwise(F.get(mine, i - 1)["end"]), c["start"], first), mark(c, _between(stretch, c["start"], c["end"], first))))
        return F.array_join(done, "")

    made = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / TOGETHER).cast("int")), part), ""), F.substring(text, F.element_at("cuts", -1)["end"] + 1, F.length(text)))
    out = rows.join(cuts, "row", "left").withColumn("made", F.when(n > 0, made).otherwise(F.col(f"kept.`{text_col}`")))
    return out.select(*[F.col("made").alias(c) if c == text_col else F.col(f"kept.`{c}`").alias(c) for c in names])


def _between(stretch: Column, start: Column, end: Column, first: Column) -> Column:
    return F.substring(stretch, start - first + 1, end - start)


def op12_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, spans = all_spans(table(spark, sf_dir, "documents"), ["doc_id"])
    name = F.element_at(F.array(*[F.lit(k) for k in (*KINDS, TERM)]), F.col("kind") + 1)
    one = F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("said"))
    got = spans.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("all"), *[F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(KINDS)])
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: s["said"]), ",")
    base = F.filter("all", lambda s: s["kind"] < len(KINDS))
    out = rows.join(got, "row", "left")
    none = lambda c: F.coalesce(c, F.lit(""))
    return out.select("kept.doc_id", *[F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(none(joined(base)), 256).alias("base_sha256"), none(joined(F.col("all"))).alias("spans"))


_LOW = f"translate({{}}, '{UPPER}', '{LOWER}')"
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _kind_sql(no: int, kind: str) -> str:
    return f"""SELECT row, {no} AS kind, unnest(range(1, len(m) + 1)) AS i, m, g FROM (SELECT row, regexp_extract_all(x, '{_PLAIN[kind]}') AS m, regexp_split_to_array(x, '{_PLAIN[kind]}') AS g FROM d)"""


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS x FROM documents),
raw AS ({" UNION ALL ".join(_kind_sql(i, k) for i, k in enumerate(KINDS))}),
placed AS (
  SELECT row, kind, m[i] AS value, (sum(length(g[i]) + length(m[i])) OVER (PARTITION BY row, kind ORDER BY i))::BIGINT AS "end", g[i] AS gap, g[i + 1] AS next,
    regexp_replace(m[i], '[^0-9]', '', 'g') AS digits FROM raw),
ok AS (
  SELECT row, kind, {_LOW.format("value")} AS value, "end" - length(value) AS start, "end",
    CASE WHEN length(gap) <= 64 THEN ' ' || gap ELSE right(gap, 65) END AS before, CASE WHEN length(next) <= 64 THEN next || ' ' ELSE left(next, 65) END AS after
  FROM placed WHERE CASE kind
    WHEN 0 THEN true
    WHEN 1 THEN len(list_filter(string_split(value, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(p AS HUGEINT), 256) > 255)) = 0
    WHEN 2 THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda j: CASE WHEN j % 2 = 0 THEN (CASE WHEN digits[-j]::INTEGER > 4 THEN 2 * digits[-j]::INTEGER - 9 ELSE 2 * digits[-j]::INTEGER END) ELSE digits[-j]::INTEGER END)) % 10 = 0
    ELSE length(digits) BETWEEN 10 AND 15 END),
c AS (SELECT row, kind, value, start - length(before) AS spot, before AS x FROM ok UNION ALL SELECT row, kind, value, "end" AS spot, after FROM ok),
w AS (SELECT row, kind, value, spot, regexp_extract_all(x, '{_WORDS}') AS w, regexp_split_to_array(x, '{_WORDS}') AS g FROM c),
wi AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w),
near AS (
  SELECT row, kind, value, {_LOW.format("w[i]")} AS term, spot + list_sum(list_transform(g[:i], lambda y: length(y))) + coalesce(list_sum(list_transform(w[:i - 1], lambda y: length(y))), 0) AS start, length(w[i]) AS n
  FROM wi WHERE length(w[i]) >= 3 AND g[i] <> '' AND g[i + 1] <> ''),
n_both AS (SELECT kind, value, term, count(DISTINCT row) AS n_both FROM near GROUP BY ALL HAVING count(DISTINCT row) >= 3),
n_entity AS (SELECT kind, value, count(DISTINCT row) AS n_entity FROM ok GROUP BY ALL),
n_term AS (SELECT term, count(*) AS n_term FROM (SELECT unnest(list_distinct(regexp_extract_all({_LOW.format("x")}, '{_WORDS}'))) AS term FROM d) GROUP BY term),
told AS (
  SELECT * FROM n_both JOIN n_entity USING (kind, value) JOIN n_term USING (term), (SELECT count(*)::DOUBLE AS total FROM d)
  WHERE n_entity < total AND round((log2(total / n_entity) + log2(n_both / n_term)) / log2(total / n_entity), 9) >= 0.75),
h AS (SELECT DISTINCT row, start, start + n AS "end" FROM near JOIN told USING (kind, value, term)),
s AS (
  SELECT row, kind, start, "end" FROM ok
  UNION ALL SELECT row, 4, start, "end" FROM h WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.row = h.row AND ok.start < h."end" AND h.start < ok."end")),
j AS (
  SELECT row, count(*) FILTER (WHERE kind = 0) AS n_email, count(*) FILTER (WHERE kind = 1) AS n_ip, count(*) FILTER (WHERE kind = 2) AS n_card, count(*) FILTER (WHERE kind = 3) AS n_phone,
    string_agg(['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, kind) AS spans,
    string_agg(['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, kind) FILTER (WHERE kind < 4) AS base FROM s GROUP BY row)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (row)
"""
