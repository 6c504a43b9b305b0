"""Text cleaning, tokenising and predicates over the documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import sampling
from ..registry import query, table
from . import sql

JOINED = lambda c: F.md5(F.array_join(c, "\t").cast("binary"))


def _document(text="text"):
    """Paragraphs of sentences."""
    return F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda p: F.split(p, r"\. "))


_DOC_SQL = "list_transform(string_split(coalesce(text, ''), chr(10)), lambda p: string_split(p, '. '))"


@query(r"SELECT page_id, md5(regexp_replace(html, '(</a>)|(<a.*?href.*?>)', '', 'g')) AS clean FROM pages")
def T01_strip_anchors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(T.strip_anchors(F.col("html")).cast("binary")).alias("clean"))


@query(f"""
WITH p AS (SELECT doc_id, unnest(l[2:]) AS par, generate_subscripts(l[2:], 1) - 1 AS i
           FROM (SELECT doc_id, {_DOC_SQL} AS l FROM documents)),
s AS (SELECT doc_id, i, unnest(par) AS t, generate_subscripts(par, 1) - 1 AS j FROM p),
c AS (SELECT *, regexp_replace(t, '(</a>)|(<a.*?href.*?>)', '', 'g') AS x FROM s),
n AS (SELECT doc_id, i, sum(length(x)) AS chars FROM c GROUP BY ALL),
r AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
k AS (SELECT doc_id, i, j, CASE WHEN x NOT LIKE ' %' AND (i > 0 OR j > 0) THEN ' ' || x ELSE x END AS x, length(x) AS len
      FROM c JOIN r USING (doc_id, i) WHERE before < 500 AND x <> '')
SELECT doc_id, md5(string_agg(x, chr(9) ORDER BY i, j)) AS lead, count(*) AS n_sentences
FROM k GROUP BY doc_id HAVING sum(len) >= 10""")
def T02_lead_paragraph(spark: SparkSession, d: str) -> DataFrame:
    lead = table(spark, d, "documents").select("doc_id", T.lead_sentences(_document()).alias("s"))
    return lead.where("s is not null").select("doc_id", JOINED("s").alias("lead"), F.size("s").cast("long").alias("n_sentences"))


@query(f"""
SELECT doc_id, md5(array_to_string(flatten(ps), chr(9))) AS clean, len(ps) AS n_paragraphs FROM (
  SELECT doc_id, list_filter(list_transform({_DOC_SQL}, lambda p: list_filter(
    list_transform(p, lambda s: regexp_replace(s, '(</a>)|(<a.*?href.*?>)', '', 'g')), lambda s: s <> '')), lambda p: len(p) > 0) AS ps
  FROM documents) WHERE len(ps) > 0""")
def T03_clean_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    clean = table(spark, d, "documents").select("doc_id", T.clean_paragraphs(_document()).alias("p")).where("p is not null")
    return clean.select("doc_id", JOINED(F.flatten("p")).alias("clean"), F.size("p").cast("long").alias("n_paragraphs"))


@query(r"""SELECT doc_id, len(l) AS n, md5(array_to_string(l, chr(9))) AS paragraphs FROM (SELECT doc_id, list_filter(list_transform(
  string_split(coalesce(text, ''), chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS l FROM documents)""")
def T04_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id", T.paragraphs(F.coalesce("text", F.lit(""))).alias("p"))
    return found.select("doc_id", F.size("p").cast("long").alias("n"), JOINED("p").alias("paragraphs"))


@query(f"SELECT doc_id, len(l) AS n_tokens, md5(array_to_string(l, chr(9))) AS tokens FROM (SELECT doc_id, {sql.tokens('text')} AS l FROM documents)")
def T05_tokens(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n_tokens"), JOINED("t").alias("tokens"))


@query("""SELECT p_partkey, array_to_string([p_name[1:3], p_name[4:7], p_name[8:12]], '|') AS pieces FROM part""")
def T08_offset_tokens(spark: SparkSession, d: str) -> DataFrame:
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 3), (3, 7), (7, 12))])
    return table(spark, d, "part").select("p_partkey", F.array_join(T.by_offsets(F.col("p_name"), spans), "|").alias("pieces"))


@query(f"""SELECT doc_id, md5(array_to_string(l[3:6], ' ')) AS piece, md5(array_to_string(list_transform(l, lambda w: lower(w)), ' ')) AS uncased
FROM (SELECT doc_id, {sql.tokens('text')} AS l FROM documents)""")
def T10_token_accessors(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    md5 = lambda c: F.md5(F.array_join(c, " ").cast("binary"))
    return found.select("doc_id", md5(T.token_slice(F.col("t"), 2, 6)).alias("piece"), md5(T.words(F.col("t"), True)).alias("uncased"))


@query("""
WITH m AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS new FROM events),
g AS (SELECT *, sum(new::int) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM m)
SELECT user_id, CAST(grp AS BIGINT) AS grp, event_type, count(*) AS n, min(event_id) AS first_id FROM g GROUP BY user_id, grp, event_type""")
def T11_tag_groups(spark: SparkSession, d: str) -> DataFrame:
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    new = ~F.col("event_type").eqNullSafe(F.lag("event_type").over(order)) | (F.row_number().over(order) == 1)
    marked = table(spark, d, "events").withColumn("new", new.cast("int"))
    grouped = marked.withColumn("grp", F.sum("new").over(order))
    return grouped.groupBy("user_id", "grp", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(f"""
WITH t AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, {sql.tokens('text')} AS l FROM documents)),
g AS (SELECT doc_id, lower(w) AS a, lower(lead(w) OVER s) AS b FROM t WINDOW s AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, count(*) + count(b) AS n_grams, count(DISTINCT a) + count(DISTINCT a || ' ' || b) AS n_distinct FROM g GROUP BY doc_id""")
def T12_ngrams(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id", T.ngrams(T.tokens(F.col("text")), 2, uncased=True).alias("g")).where("size(g) > 0")
    return found.select("doc_id", F.size("g").cast("long").alias("n_grams"), F.size(F.array_distinct("g")).cast("long").alias("n_distinct"))


_MODES = "SELECT item_id, mode, count(*) AS n FROM k WHERE NOT CASE mode WHEN 'any' THEN a OR coalesce(b, false) WHEN 'all' THEN a AND coalesce(b, true) ELSE a OR coalesce(b, a) END GROUP BY ALL"


@query(f"""
WITH t AS ({sql.positions('benchmark', 'item_id')}),
u AS (SELECT item_id, drop AS a, lead(drop) OVER (PARTITION BY item_id ORDER BY pos) AS b FROM t),
g AS (SELECT item_id, a, NULL::boolean AS b FROM u UNION ALL SELECT item_id, a, b FROM u WHERE b IS NOT NULL),
k AS (SELECT * FROM g, (VALUES ('any'), ('all'), ('ends')) AS m(mode)) {_MODES}""")
def T13_ngram_filter(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark")
    rows = [
        items.select("item_id", F.lit(m).alias("mode"), F.explode(T.ngrams(T.tokens(F.col("text")), 2, True, m)).alias("g"))
        for m in ("any", "all", "ends")
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("item_id", "mode").agg(F.count("*").alias("n"))


@query(f"SELECT w, count(*) AS n FROM ({sql.positions('documents', 'doc_id')}) WHERE drop GROUP BY w")
def T14_filtered_words(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("t"))
    return words.where(T.is_filtered_word(F.col("t"))).groupBy(F.lower("t").alias("w")).agg(F.count("*").alias("n"))


@query(f"SELECT conv_id, turn, md5({sql.normalized('text')}) AS answer FROM conversations")
def T17_normalize_answer(spark: SparkSession, d: str) -> DataFrame:
    answer = F.md5(T.normalize_answer(F.col("text")).cast("binary"))
    return table(spark, d, "conversations").select("conv_id", "turn", answer.alias("answer"))


@query("SELECT page_id, replace(url_decode(url), '_', ' ') AS title FROM pages")
def T19_unescape_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.unescape_title(F.col("url")).alias("title"))


@query(r"""SELECT p_partkey, regexp_extract(name, '^(.*)_[^_]*$', 1) AS title, CAST(regexp_extract(name, '_([^_]*)$', 1) AS INT) AS number
FROM (SELECT p_partkey, replace(p_name, ' ', '_') || '_' || p_size AS name FROM part)""")
def T20_paragraph_names(spark: SparkSession, d: str) -> DataFrame:
    name = T.paragraph_name(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.col("p_size"))
    named = table(spark, d, "part").select("p_partkey", name.alias("name"))
    return named.select("p_partkey", T.name_title(F.col("name")).alias("title"), T.name_number(F.col("name")).alias("number"))


@query(f"""
WITH t AS (SELECT item_id, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM (SELECT item_id, {sql.tokens('text')} AS l FROM benchmark)),
s AS (SELECT item_id, pos, coalesce(sum((w = '.')::int) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM t)
SELECT item_id, string_agg(CAST(seg AS INT)::varchar, ',' ORDER BY pos) AS segments FROM s GROUP BY item_id""")
def T21_sentence_segments(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "benchmark").select("item_id", T.sentence_segments(T.tokens(F.col("text"))).alias("s")).where("size(s) > 0")
    return found.select("item_id", F.array_join(F.transform("s", lambda n: n.cast("string")), ",").alias("segments"))


_SENTENCES = f"list_transform(string_split(text, '.'), lambda s: {sql.tokens('s')})"


def _tokenised(text="text"):
    return F.transform(F.split(F.col(text), r"\."), lambda s: T.tokens(s))


@query(f"""
WITH s AS (SELECT item_id, unnest(l) AS toks, generate_subscripts(l, 1) AS i FROM (SELECT item_id, list_filter({_SENTENCES}, lambda x: len(x) > 0) AS l FROM benchmark)),
t AS (SELECT item_id, i - 1 AS seg, unnest(toks) AS w FROM s)
SELECT item_id, count(*) AS n, CAST(sum(seg) AS BIGINT) AS total, CAST(max(seg) AS INT) AS last FROM t GROUP BY item_id""")
def T22_list_segments(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "benchmark").select("item_id", F.explode(T.list_segments(_tokenised())).alias("seg"))
    return found.groupBy("item_id").agg(F.count("*").alias("n"), F.sum("seg").alias("total"), F.max("seg").alias("last"))


@query(f"""
WITH s AS (SELECT item_id, unnest(l) AS toks, generate_subscripts(l, 1) - 1 AS i FROM (SELECT item_id, {_SENTENCES} AS l FROM benchmark)),
k AS (SELECT item_id, i, len(toks) = 0 AS empty FROM s)
SELECT item_id, CAST(max(i) FILTER (WHERE NOT empty) AS BIGINT) AS before,
  CAST(count(*) FILTER (WHERE NOT empty) - 1 AS BIGINT) AS after FROM k GROUP BY item_id HAVING count(*) FILTER (WHERE NOT empty) > 0""")
def T23_shift_supporting(spark: SparkSession, d: str) -> DataFrame:
    """The index of the last sentence with tokens, before and after empty sentences go."""
    found = table(spark, d, "benchmark").select("item_id", _tokenised().alias("s"))
    last = F.array_max(F.transform("s", lambda x, i: F.when(F.size(x) > 0, i)))
    found = found.select("item_id", "s", last.alias("before")).where("before is not null")
    after = F.get(T.shift_supporting(F.col("s"), F.array("before")), 0)
    return found.select("item_id", F.col("before").cast("long").alias("before"), after.cast("long").alias("after"))


@query(f"""SELECT a.item_id, len(a.l) + len(b.l) AS n_tokens, md5(array_to_string(list_concat(a.l, b.l), ' ')) AS merged, len(a.l) AS span_offset
FROM (SELECT item_id, {sql.tokens('text')} AS l FROM benchmark) a JOIN (SELECT item_id, {sql.tokens('text')} AS l FROM benchmark) b ON b.item_id = a.item_id + 1""")
def T24_merge_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select("item_id", T.tokens(F.col("text")).alias("l"))
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("l").alias("m"))
    both = items.join(after, "item_id").select("item_id", "l", F.concat("l", "m").alias("all"))
    return both.select(
        "item_id", F.size("all").cast("long").alias("n_tokens"), F.md5(F.array_join("all", " ").cast("binary")).alias("merged"),
        F.size("l").cast("long").alias("span_offset"),
    )


@query("""
WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT) % 5 + 1 AS size,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS ord FROM lineitem),
r AS (SELECT *, sum(size) OVER (PARTITION BY l_orderkey ORDER BY ord) AS cum_end FROM n)
SELECT o_orderkey, ord AS paragraph, CAST(CAST(floor(o_totalprice) AS BIGINT) % 12 - (cum_end - size) AS BIGINT) AS sentence
FROM orders JOIN r ON o_orderkey = l_orderkey
WHERE CAST(floor(o_totalprice) AS BIGINT) % 12 >= cum_end - size AND CAST(floor(o_totalprice) AS BIGINT) % 12 < cum_end""")
def T25_unmerge_sentence(spark: SparkSession, d: str) -> DataFrame:
    """A merged sentence index back to its paragraph and its place in it."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    size = F.col("l_quantity").cast("int") % 5 + 1
    pieces = table(spark, d, "lineitem").select("l_orderkey", size.alias("size"), F.row_number().over(order).cast("long").alias("ord"))
    ends = W.partitionBy("l_orderkey").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    pieces = pieces.withColumn("cum_end", F.sum("size").over(ends))
    asked = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice").cast("long") % 12).alias("i"))
    met = asked.join(pieces, F.col("o_orderkey") == F.col("l_orderkey")).where("i >= cum_end - size and i < cum_end")
    return met.select("o_orderkey", F.col("ord").alias("paragraph"), (F.col("i") - (F.col("cum_end") - F.col("size"))).alias("sentence"))


@query(f"SELECT item_id, array_to_string(l[3:6], ' ') AS span FROM (SELECT item_id, {sql.tokens('text')} AS l FROM benchmark)")
def T26_sub_span(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", T.sub_span_text(t, F.lit(2), F.lit(5)).alias("span"))


@query(f"""SELECT item_id, len(flatten(s)) AS n_flat, len(s) AS n_rows, list_max(list_transform(s, lambda x: len(x))) AS n_columns
FROM (SELECT item_id, {_SENTENCES} AS s FROM benchmark)""")
def T27_flatten(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "benchmark").select("item_id", _tokenised().alias("s"))
    long = lambda c: c.cast("long")
    return found.select(
        "item_id", long(F.size(F.flatten("s"))).alias("n_flat"), long(F.size("s")).alias("n_rows"),
        long(F.array_max(F.transform("s", lambda x: F.size(x)))).alias("n_columns"),
    )


@query(f"""SELECT item_id, generate_subscripts(s, 1) - 1 AS sentence, md5(array_to_string(unnest(s), ' ')) AS tokens
FROM (SELECT item_id, {_SENTENCES} AS s FROM benchmark)""")
def T28_tokenize_sentences(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "benchmark").select("item_id", F.posexplode(_tokenised()).alias("sentence", "t"))
    return found.select("item_id", F.col("sentence").cast("long").alias("sentence"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens"))


_VOCAB = f"SELECT w, count(*) AS n FROM ({sql.positions('documents', 'doc_id')}) GROUP BY w"


@query(f"""
WITH v AS ({_VOCAB}), ids AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) + 1 AS id FROM v WHERE n >= 50),
q AS (SELECT item_id, unnest(l) AS t, generate_subscripts(l, 1) AS pos FROM (SELECT item_id, {sql.tokens('text')} AS l FROM benchmark))
SELECT item_id, pos, CAST(coalesce(a.id, b.id, 1) AS BIGINT) AS id FROM q LEFT JOIN ids a ON a.w = t LEFT JOIN ids b ON b.w = lower(t)""")
def T29_token_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the words with 50 uses or more; a token falls back to its lower case, then to 1."""
    words = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("t")).groupBy(F.lower("t").alias("w"))
    vocab = words.agg(F.count("*").alias("n")).where("n >= 50")
    ids = sampling.numbered(vocab.withColumnRenamed("n", "uses"), [F.desc("uses"), F.col("w")]).select("w", (F.col("n") + 2).cast("long").alias("id"))
    asked = table(spark, d, "benchmark").select("item_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "t"))
    exact = ids.select(F.col("w").alias("t"), F.col("id").alias("exact"))
    lower = ids.select(F.col("w").alias("lt"), F.col("id").alias("lower"))
    met = asked.join(exact, "t", "left").join(lower, F.lower("t") == F.col("lt"), "left")
    return met.select("item_id", (F.col("pos") + 1).cast("long").alias("pos"), F.coalesce("exact", "lower", F.lit(1)).alias("id"))


@query(f"""SELECT item_id, array_to_string(list_concat([-1], list_transform(l, lambda w: length(w)), [-2]), ',') AS ids
FROM (SELECT item_id, {sql.tokens('text')} AS l FROM benchmark)""")
def T31_framed_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = T.token_ids(T.tokens(F.col("text")), -1, -2, F.length)
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("ids"))


@query("""SELECT user_id, event_id, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY first_ts, first_id) - 1 AS INT) AS group_id,
  CASE event_type WHEN 'purchase' THEN 1 ELSE 0 END AS label
FROM (SELECT *, first_value(ts) OVER w AS first_ts, first_value(event_id) OVER w AS first_id FROM events
      WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))""")
def T33_labels(spark: SparkSession, d: str) -> DataFrame:
    """Binary labels, and groups numbered by first appearance."""
    own = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("first", F.first(F.struct("ts", "event_id")).over(own))
    rank = F.dense_rank().over(W.partitionBy("user_id").orderBy("first")) - 1
    label = F.when(F.col("event_type") == "purchase", 1).otherwise(0)
    return rows.select("user_id", "event_id", rank.alias("group_id"), label.alias("label"))


@query("SELECT item_id FROM benchmark WHERE instr(text, '?') > 0")
def P01_has_question_mark(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").where(F.instr("text", "?") > 0).select("item_id")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 4")
def P02_enough_distractors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n >= 4")


@query("""SELECT o_orderkey FROM orders JOIN (SELECT l_orderkey, count(*) AS n, bool_or(l_returnflag = 'R') AS gold FROM lineitem GROUP BY 1)
ON o_orderkey = l_orderkey WHERE n >= 2 AND (gold OR o_orderpriority = '1-URGENT')""")
def P03_gold_or_yes_no(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("gold"))
    met = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return met.where("n >= 2 and (gold or o_orderpriority = '1-URGENT')").select("o_orderkey")


_PREFIX = f"""
WITH s AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
c AS (SELECT doc_id, i, len({sql.tokens('t')}) AS n FROM s),
r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM c)"""


def _prefix(spark: SparkSession, d: str) -> DataFrame:
    """Sentences (lines) with the tokens up to and with each."""
    parts = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "t"))
    counted = parts.select("doc_id", "i", F.size(T.tokens(F.col("t"))).alias("n"))
    upto = W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    return counted.withColumn("upto", F.sum("n").over(upto))


@query(f"{_PREFIX} SELECT doc_id, count(*) FILTER (WHERE upto <= 200) AS kept FROM r GROUP BY doc_id")
def P04_truncate_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _prefix(spark, d).groupBy("doc_id").agg(F.count(F.when(F.col("upto") <= 200, 1)).alias("kept"))


@query(f"{_PREFIX} SELECT doc_id, count(*) FILTER (WHERE upto <= 200) AS kept FROM r GROUP BY doc_id HAVING NOT bool_or(i = 2 AND upto > 200)")
def P05_truncate_or_reject(spark: SparkSession, d: str) -> DataFrame:
    """As P04, but a document whose second sentence, taken as supporting, would be cut is rejected."""
    cut = F.bool_or((F.col("i") == 1) & (F.col("upto") > 200)).alias("cut")
    rows = _prefix(spark, d).groupBy("doc_id").agg(F.count(F.when(F.col("upto") <= 200, 1)).alias("kept"), cut)
    return rows.where("not cut").select("doc_id", "kept")


@query(f"SELECT doc_id, md5(array_to_string({sql.tokens('text')}[1:100], ' ')) AS tokens FROM documents")
def P06_first_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(F.slice(T.tokens(F.col("text")), 1, 100), " ").cast("binary")).alias("tokens"))


@query(f"SELECT DISTINCT doc_id FROM ({sql.positions('documents', 'doc_id')}) WHERE NOT drop")
def P07_has_ngram(spark: SparkSession, d: str) -> DataFrame:
    grams = T.ngrams(T.tokens(F.col("text")), 1, True, "any")
    return table(spark, d, "documents").where(F.size(grams) > 0).select("doc_id")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def P08_answer_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an item's text.

    Only keys travel: each text's runs of four words, or for shorter items its single
    words or runs of up to three characters, meet one key of each item, and texts are
    read for the pairs that meet. An empty item is held by every text.
    """
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("answer"))
    docs = table(spark, d, "documents").select("doc_id", "text").where("text is not null")
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    sized = items.withColumn("w", words(F.col("answer")))
    n = F.size("w")
    # Words inside an item are whole in any text that holds it; at its ends a text's word may go on.
    kind = F.when(n >= 6, "run").when(n >= 3, "word").otherwise("chars")
    key = F.when(n >= 6, F.array_join(F.slice("w", 2, 4), " ")).when(n >= 3, F.get("w", 1)).otherwise(F.left("answer", F.lit(3)))
    keyed = sized.select("item_id", kind.alias("kind"), key.alias("key"))

    def meet(kind: str, keys: Column) -> DataFrame:
        asked = keyed.where(F.col("kind") == kind).select("item_id", "key")
        return docs.select("doc_id", F.explode(keys).alias("key")).join(asked, "key").select("doc_id", "item_id")

    runs = T.let(words(F.col("text")), lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 3)), lambda i: F.array_join(F.slice(w, i, 4), " ")))
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text")))
    cuts = F.flatten(F.transform(places, lambda i: F.array(*[F.substring("text", i, F.lit(k)) for k in (1, 2, 3)])))
    chars = F.concat(F.array(F.lit("")), cuts)
    met = meet("run", F.array_distinct(runs)).union(meet("word", F.array_distinct(words(F.col("text"))))).union(meet("chars", F.array_distinct(chars)))
    found = met.distinct().join(docs, "doc_id").join(items, "item_id").where(F.contains("text", "answer")).select("item_id", "doc_id")
    return found


@query(f"""
SELECT doc_id, CAST(i - 1 AS BIGINT) AS number FROM (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM
 (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)) WHERE len({sql.tokens('t')}) > 0""")
def P09_paragraphs_with_tokens(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("number", "t"))
    return parts.where(F.size(T.tokens(F.col("t"))) > 0).select("doc_id", F.col("number").cast("long").alias("number"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def P10_not_yet_encoded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id FROM documents WHERE length(text) > 500")
def P11_long_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.length("text") > 500).select("doc_id")


@query("SELECT event_id FROM events WHERE event_type = 'click'")
def P12_type_slice(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'click'").select("event_id")


@query("""SELECT (SELECT count(*) FROM documents) AS total, count(*) AS kept,
  round(100.0 * ((SELECT count(*) FROM documents) - count(*)) / (SELECT count(*) FROM documents), 6) AS percent FROM documents WHERE length(text) > 500""")
def P14_percent_filtered(spark: SparkSession, d: str) -> DataFrame:
    kept = F.count(F.when(F.length("text") > 500, 1))
    total = F.count("*")
    return table(spark, d, "documents").agg(total.alias("total"), kept.alias("kept"), F.round(F.lit(100.0) * (total - kept) / total, 6).alias("percent"))


@query("SELECT conv_id, turn, regexp_full_match(lower(trim(text)), '(yes|no)[.!]?') AS yes_no FROM conversations")
def P15_yes_no(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.lower(F.trim("text")).rlike(r"^(yes|no)[.!]?$").alias("yes_no"))


@query(f"SELECT doc_id, CASE WHEN len({sql.tokens('text')}) > 900 THEN 'long' ELSE 'short' END AS size FROM documents")
def P16_long_short(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(F.size(T.tokens(F.col("text"))) > 900, "long").otherwise("short")
    return table(spark, d, "documents").select("doc_id", size.alias("size"))


@query(f"""SELECT item_id, least(len(l), 20) AS n, array_to_string(list_resize(list_transform(l[1:20], lambda w: length(w)), 20, 0), ',') AS padded
FROM (SELECT item_id, {sql.tokens('text')} AS l FROM benchmark)""")
def T32_padded_indexes(spark: SparkSession, d: str) -> DataFrame:
    """Token indexes (here lengths) cut and padded with 0 to 20, with the true length."""
    rows = table(spark, d, "benchmark").select("item_id", F.slice(T.tokens(F.col("text")), 1, 20).alias("t"))
    padded = F.concat(F.transform("t", F.length), F.array_repeat(F.lit(0), 20 - F.size("t")))
    return rows.select("item_id", F.size("t").cast("long").alias("n"), F.array_join(F.transform(padded, lambda n: n.cast("string")), ",").alias("padded"))
