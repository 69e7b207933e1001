"""The library's queries over the driver's tables, and the same questions in SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import spans, text
from spanloom.operators import align, baselines, dataset, evaluate, render, tokens
from spanloom.plans import fixture
from spanloom.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# ---------------------------------------------------------------------------------------------------------- SQL fragments


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_norm(x: str) -> str:
    """The normalised text of an SQL expression, from the same table as the column function."""
    t = {k: v for k, v in text.transliteration().items() if k < "\u0250" and len(k) == 1}  # all that the driver's tables hold
    one = {k: v for k, v in t.items() if len(v) == 1}
    out = f"translate({x}, {_quoted(''.join(one))}, {_quoted(''.join(one.values()))})"
    for k, v in t.items():
        if len(v) != 1:
            out = f"replace({out}, {_quoted(k)}, {_quoted(v)})"
    return sql_squash(f"regexp_replace({out}, '[^\\x00-\\x7F]', '', 'g')")


def sql_squash(x: str) -> str:
    return f"regexp_replace({x}, '[\\s\\x0b\\x1c-\\x1f]+', ' ', 'g')"


def sql_words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def _bucket(x: str, n: str) -> str:
    return f"(('0x' || substr(md5(CAST({x} AS VARCHAR)), 1, 8))::BIGINT % {n})"


LINES = f"""lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS par FROM documents
), para AS (
  SELECT doc_id * 10000000 + par AS pair_id, doc_id, source, w FROM (SELECT doc_id, par, source, {sql_words('source')} AS w FROM (SELECT doc_id, par, {sql_squash('line')} AS source FROM lines)) WHERE len(w) >= 8
)"""
PAIRS = LINES + ", pairs AS (SELECT pair_id, source, array_to_string(w[3:8], ' ') AS target FROM para)"
ABLATED = LINES + f", pairs AS (SELECT pair_id, source, array_to_string(list_concat(t[1:k], t[k + 2:]), ' ') AS target FROM (SELECT pair_id, source, w[3:8] AS t, 1 + {_bucket('pair_id', '4')} AS k FROM para))"
NORM = f"""norm AS MATERIALIZED (SELECT *, {sql_words('ns')} AS src FROM (SELECT *, {sql_norm('source')} AS ns, {sql_words(sql_norm('target'))} AS t FROM pairs))"""
TOKENS = """s AS MATERIALIZED (
  SELECT pair_id, tok, pos, CAST(lead + coalesce(sum(length(tok) + 1) OVER (PARTITION BY pair_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_idx
  FROM (SELECT pair_id, CASE WHEN starts_with(ns, ' ') THEN 1 ELSE 0 END AS lead, unnest(src) AS tok, generate_subscripts(src, 1) - 1 AS pos FROM norm)
), t AS MATERIALIZED (SELECT pair_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM norm)"""
STEPS = """f AS (SELECT * FROM t SEMI JOIN s USING (pair_id, tok)),
d AS (SELECT pair_id, i, tok, lag(tok) OVER (PARTITION BY pair_id ORDER BY i) AS pv FROM f),
st AS MATERIALIZED (SELECT pair_id, tok, row_number() OVER (PARTITION BY pair_id ORDER BY i) AS step, count(*) OVER (PARTITION BY pair_id) AS n FROM d WHERE pv IS NULL OR pv <> tok)"""
CHAINS = """c AS (SELECT st.pair_id, st.step, st.n, s.pos FROM st JOIN s USING (pair_id, tok)),
p(pair_id, step, n, last_pos, path) AS (
  SELECT pair_id, step, n, pos, [pos] FROM c WHERE step = 1
  UNION ALL
  SELECT p.pair_id, c.step, p.n, c.pos, list_append(p.path, c.pos) FROM p JOIN c ON c.pair_id = p.pair_id AND c.step = p.step + 1 AND c.pos > p.last_pos
), aln AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY path) - 1 AS alignment_id, path FROM p WHERE step = n)"""
FIRST = """per AS (SELECT pair_id, count(*) AS n, min(path) AS first, list_sort(list_distinct(list(path[1]))) AS starts FROM aln GROUP BY pair_id),
base AS (SELECT norm.*, coalesce(per.n, 0) AS n, per.first, coalesce(per.starts, CAST([] AS BIGINT[])) AS starts FROM norm LEFT JOIN per USING (pair_id))"""
ALL = ", ".join((PAIRS, NORM, TOKENS, STEPS, CHAINS))
BASE = ALL + ", " + FIRST
BASE_ABLATED = ", ".join((ABLATED, NORM, TOKENS, STEPS, CHAINS, FIRST))
#: Scores of our own method and of the first exact occurrence; the true start is that of the target's first word.
SCORED = BASE + """, tok AS (
  SELECT base.pair_id, list(s.tok ORDER BY x.k) AS first_tokens FROM base, unnest(base.first) WITH ORDINALITY AS x(p, k) JOIN s ON s.pair_id = base.pair_id AND s.pos = x.p GROUP BY base.pair_id
), pred AS (
  SELECT base.pair_id, list(s.start_idx ORDER BY s.start_idx) AS custom FROM base, unnest(base.starts) AS x(p) JOIN s ON s.pair_id = base.pair_id AND s.pos = x.p GROUP BY base.pair_id
), gold AS (SELECT pair_id, start_idx AS g FROM s WHERE pos = 2),
scored AS (
  SELECT pair_id, len(src) AS n_tokens, gold.g AS gold, coalesce(pred.custom, [-1]) AS custom_starts, [instr(source, target) - 1] AS naive_starts,
         list_contains(coalesce(pred.custom, [-1]), gold.g) AS custom_found, instr(source, target) - 1 = gold.g AS naive_found,
         coalesce(array_to_string(tok.first_tokens, ' '), '') = trim(target) AS custom_same, instr(source, target) > 0 AS naive_same,
         CASE WHEN tok.first_tokens IS NULL THEN 0.0 ELSE len(list_distinct(tok.first_tokens)) END / nullif(len(t), 0) AS coverage, len(t) AS n_target
  FROM base JOIN gold USING (pair_id) LEFT JOIN pred USING (pair_id) LEFT JOIN tok USING (pair_id)
)"""
RECORDS = LINES + """, off AS (SELECT *, CASE WHEN starts_with(source, ' ') THEN 1 ELSE 0 END AS lead FROM para),
records AS (
  SELECT pair_id, kind, source, array_to_string(w[a:a + m - 1], ' ') AS target,
         CAST(lead + coalesce(list_sum(list_transform(w[1:a - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS idx_start
  FROM off, (VALUES (0::BIGINT, 3, 6), (1, 5, 1), (2, 2, 4)) AS k(kind, a, m)
)"""
NAIVE = RECORDS + ", naive AS (SELECT * FROM records WHERE instr(source, target) - 1 = idx_start)"
DEDUP = NAIVE + ", dedup AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY source, target, idx_start ORDER BY pair_id, kind) AS rn FROM naive) WHERE rn = 1)"
CLEAN = DEDUP + f", clean AS (SELECT * FROM dedup WHERE length({sql_norm('source')}) = length(source) AND length({sql_norm('target')}) = length(target))"
SHIFTED = CLEAN + """, shifted AS (
  SELECT pair_id, kind, source, CASE WHEN b THEN ' ' || target ELSE target END AS target, CASE WHEN b THEN idx_start - 1 ELSE idx_start END AS idx_start, idx_start AS idx_start_orig, target AS target_orig
  FROM (SELECT *, idx_start > 0 AND substr(source, idx_start, 1) = ' ' AS b FROM clean)
)"""
SHIFT_RULE = "coalesce(bool_and(CASE WHEN idx_start <> idx_start_orig THEN idx_start_orig > 0 AND substr(source, idx_start_orig, 1) = ' ' AND idx_start = idx_start_orig - 1 AND target = ' ' || target_orig END), true)"


def with_(fragment: str, select: str) -> str:
    return f"WITH RECURSIVE {fragment} {select}"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# ----------------------------------------------------------------------------------------------------------------- helpers


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _prepared(s: SparkSession, d: str, ablated: bool = False) -> DataFrame:
    return fixture.prepared(fixture.pairs(s, d, ablated))


def _with_starts(s: SparkSession, d: str) -> DataFrame:
    return _prepared(s, d).withColumn("starts_at", spans.token_starts(F.col("src"), fixture.lead()))


def _starts() -> Column:
    return spans.start_positions(F.col("cand"), F.col("last"))


def _count() -> Column:
    return spans.count_alignments(F.col("cand")).cast("bigint")


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("bigint").alias(f.name) if f.dataType.simpleString() in ("int", "smallint") else F.col(f.name) for f in df.schema])


def _text(c: str) -> Column:
    return _text_of(F.col(c))


def _text_of(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), ",")


def _src_tokens(s: SparkSession, d: str) -> DataFrame:
    return tokens.whitespace_tokens(fixture.pairs(s, d), "pair_id", "source")


def _met_tokens(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Tokens of the sources that the targets have too, and tokens of the targets: what alignments are made of."""
    return tokens.whitespace_tokens(fixture.pairs(s, d), "pair_id", "source", among="target"), _tgt_tokens(s, d)


def _tgt_tokens(s: SparkSession, d: str) -> DataFrame:
    return tokens.whitespace_tokens(fixture.pairs(s, d), "pair_id", "target")


def _first_tokens(df: DataFrame) -> DataFrame:
    """Prepared pairs with the token objects of the first alignment."""
    out = df.withColumn("starts_at", spans.token_starts(F.col("src"), fixture.lead()))
    return out.withColumn("tokens", render.token_objects(F.col("src"), F.col("starts_at"), F.col("first")))


def _present(c: Column) -> Column:
    """Only rows with a value. A filter would be pushed below the alignment, whose expressions would then be nested in it."""
    return F.explode(F.filter(F.array(c), lambda x: x.isNotNull()))


def scored(s: SparkSession, d: str) -> DataFrame:
    """Scores of our own method and of the first exact occurrence on the standard pairs."""
    p = _first_tokens(_prepared(s, d)).withColumn("starts", _starts())
    p = p.withColumn("custom_starts", F.when(F.size("starts") > 0, F.transform("starts", lambda i: F.get("starts_at", i).cast("int"))).otherwise(F.array(F.lit(-1))))
    p = p.withColumn("naive_starts", F.array(text.find("source", "target").cast("int"))).withColumn("gold", F.get("starts_at", 2).cast("int"))
    joined = F.coalesce(render.by_token(F.col("tokens"), " "), F.lit(""))
    # sizes are never null, which a join by them would have to ask below all expressions
    n_target = text.word_count(text.norm_text("target"))
    return p.select(
        "pair_id", F.coalesce(F.size("src"), F.lit(0)).alias("n_tokens"), "gold", "custom_starts", "naive_starts", F.array_contains("custom_starts", F.col("gold")).alias("custom_found"), F.array_contains("naive_starts", F.col("gold")).alias("naive_found"),
        (joined == F.trim("target")).alias("custom_same"), (F.get("naive_starts", 0) >= 0).alias("naive_same"), evaluate.coverage(F.transform("tokens", lambda t: t["token"]), n_target).alias("coverage"), n_target.alias("n_target"),
    )


FLAGS = ["custom_found", "naive_found", "custom_same", "naive_same"]
ORDER = ["pair_id", "kind"]


def _rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _r(x: str, name: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) AS {name}"


def _bpe():
    return tokens.subword_tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


# --------------------------------------------------------------------------------------------------- texts, tokens, indexes


@query("norm_text_documents", f"SELECT doc_id, {sql_norm('text')} AS norm FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", text.norm_text("text").alias("norm"))


@query("len_preserved_documents", f"SELECT doc_id, length({sql_norm('text')}) = length(text) AS kept FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", text.len_preserved("text").alias("kept"))


@query("text_functions", "SELECT conv_id, turn, length(text) AS n_chars, trim(text, ' ') AS stripped, starts_with(text, 'Th') AS starts, contains(text, 'the') AS has, instr(text, 'the') - 1 AS at, substr(text, 3, 5) AS piece, regexp_matches(text, '[0-9]{2}') AS digits FROM conversations")
def _(s, d):
    t = F.col("text")
    return table(s, d, "conversations").select("conv_id", "turn", F.length(t).cast("bigint").alias("n_chars"), F.trim(t).alias("stripped"), F.startswith(t, F.lit("Th")).alias("starts"), F.contains(t, F.lit("the")).alias("has"), text.find(t, F.lit("the")).cast("bigint").alias("at"), text.cut(t, F.lit(2), F.lit(5)).alias("piece"), t.rlike("[0-9]{2}").alias("digits"))


@query("ws_tokens", with_(PAIRS + ", " + NORM + ", " + TOKENS, "SELECT pair_id, pos, tok AS token, start_idx, start_idx + length(tok) AS end_idx FROM s"))
def _(s, d):
    return _longs(_src_tokens(s, d).drop("enc_token"))


@query("token_counts", f"SELECT doc_id, len({sql_words(sql_norm('text'))}) AS n_tokens, len({sql_words(sql_squash('text'))}) AS n_words FROM documents")
def _(s, d):
    return _longs(_docs(s, d).select("doc_id", text.word_count(text.norm_text("text")).alias("n_tokens"), text.word_count("text").alias("n_words")))


@query("token_occurrence_map", with_(PAIRS + ", " + NORM + ", " + TOKENS, "SELECT pair_id, tok AS token, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM s GROUP BY pair_id, tok"))
def _(s, d):
    return tokens.text_postings(fixture.pairs(s, d), "pair_id", "source", 1).select("pair_id", F.get("ngram", 0).alias("token"), _text("positions").alias("positions"))


@query("mean_word_length", f"SELECT {_r('avg(length(w))', 'mean_word_length')} FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents)")
def _(s, d):
    return _rounded(evaluate.mean_word_length(_docs(s, d), "text"))


def _ngram_sql(k: int) -> str:
    gram = " || ' ' || ".join(f"lead(tok, {j}) OVER w" if j else "tok" for j in range(k))
    return PAIRS + ", " + NORM + ", " + TOKENS + f""", g AS (SELECT * FROM (SELECT pair_id, pos, {gram} AS ngram FROM s WINDOW w AS (PARTITION BY pair_id ORDER BY pos)) WHERE ngram IS NOT NULL),
gi AS MATERIALIZED (SELECT pair_id, pos, ngram, dense_rank() OVER (PARTITION BY pair_id ORDER BY fp) - 1 AS ngram_id FROM (SELECT *, min(pos) OVER (PARTITION BY pair_id, ngram) AS fp FROM g))"""


def _index(s, d, k):
    return tokens.text_ngrams(fixture.pairs(s, d), "pair_id", "source", k)


for _k in (1, 2, 3):
    query(f"ngram_index_k{_k}", with_(_ngram_sql(_k), "SELECT pair_id, pos, ngram, ngram_id FROM gi"))(lambda s, d, k=_k: _longs(_index(s, d, k).withColumn("ngram", F.array_join("ngram", " "))))


@query("ngram_postings", with_(_ngram_sql(2), "SELECT pair_id, ngram_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM gi GROUP BY pair_id, ngram_id"))
def _(s, d):
    return _longs(tokens.text_postings(fixture.pairs(s, d), "pair_id", "source", 2).select("pair_id", "ngram_id", _text("positions").alias("positions")))


@query("ngram_dictionary", with_(_ngram_sql(2), "SELECT DISTINCT pair_id, ngram_id, ngram FROM gi"))
def _(s, d):
    return _longs(tokens.text_postings(fixture.pairs(s, d), "pair_id", "source", 2).select("pair_id", "ngram_id", F.array_join("ngram", " ").alias("ngram")))


@query("ngram_graph_k2", with_(_ngram_sql(2), ", u AS MATERIALIZED (SELECT DISTINCT pair_id, ngram_id, split_part(ngram, ' ', 1) AS one, split_part(ngram, ' ', 2) AS two FROM gi) SELECT a.pair_id, a.ngram_id AS src_id, b.ngram_id AS dst_id FROM u a JOIN u b ON a.pair_id = b.pair_id AND a.two = b.one AND a.ngram_id <> b.ngram_id"))
def _(s, d):
    return _longs(tokens.text_graph(fixture.pairs(s, d), "pair_id", "source", 2))


@query("bpe_tokens")
def _(s, d):
    return tokens.subword_tokens(fixture.pairs(s, d), "pair_id", "source", _bpe())


# ------------------------------------------------------------------------------------------------------------- alignments


@query("target_candidates", with_(", ".join((PAIRS, NORM, TOKENS, STEPS)), "SELECT st.pair_id, st.step, st.n, s.pos FROM st JOIN s USING (pair_id, tok)"))
def _(s, d):
    """Every position of every step, made in the pair's row; ``align_all_joins`` finds the same by joins."""
    # one array of all, as of a column that is exploded Spark asks below whether it is empty, and there makes it again
    each = F.flatten(F.transform("cand", lambda x, i: F.transform(x, lambda p: F.struct((i + 1).alias("step"), p.alias("pos")))))
    steps = _prepared(s, d).select("pair_id", F.size("q").alias("n"), F.explode(F.filter(each, lambda x: x["step"] > 0)).alias("t"))
    return _longs(steps.select("pair_id", "t.step", "n", "t.pos"))


#: Targets of one pair in sources of the next, so that some words are not there.
CROSSED = LINES + ", pairs AS (SELECT pair_id, source, lead(array_to_string(w[3:8], ' ')) OVER (PARTITION BY doc_id ORDER BY pair_id) AS target FROM para)"


def _crossed(s, d):
    from pyspark.sql import Window

    p = fixture.paragraphs(_docs(s, d))
    return p.select("pair_id", "source", F.lead(F.array_join(F.slice("w", 3, 6), " ")).over(Window.partitionBy("doc_id").orderBy("pair_id")).alias("target"))


def _crossed_tokens(s, d):
    p = _crossed(s, d)
    return tokens.whitespace_tokens(p, "pair_id", "source"), tokens.whitespace_tokens(p, "pair_id", "target")


@query("unmatched_target_tokens", with_(", ".join((CROSSED, NORM, TOKENS)), "SELECT pair_id, i - 1 AS pos, tok AS token FROM t ANTI JOIN s USING (pair_id, tok)"))
def _(s, d):
    src, tgt = _crossed_tokens(s, d)
    return _longs(align.unmatched(tgt, src, "pair_id").select("pair_id", "pos", "token"))


@query("collapsed_steps", with_(", ".join((CROSSED, NORM, TOKENS, STEPS)), "SELECT pair_id, step, n, tok AS token FROM st"))
def _(s, d):
    src, tgt = _crossed_tokens(s, d)
    return _longs(align.collapsed_steps(tgt, src, "pair_id").withColumnRenamed("enc_token", "token"))


@query("zero_alignment_pairs", with_(", ".join((CROSSED, NORM, TOKENS, STEPS, CHAINS)), "SELECT pair_id, source, target FROM pairs ANTI JOIN aln USING (pair_id)"))
def _(s, d):
    p = _crossed(s, d)
    none = fixture.prepared(p).withColumn("none", F.col("first").isNull())
    return none.select("pair_id", "source", "target", F.explode(F.filter(F.array("none"), lambda x: x)).alias("none")).drop("none")


def _paths(df: DataFrame) -> DataFrame:
    return _longs(df.withColumn("path", _text("path")))


PATHS = "SELECT pair_id, alignment_id, array_to_string(path, ',') AS path FROM aln"


@query("align_all", with_(ALL, PATHS))
def _(s, d):
    return _paths(align.alignments(_prepared(s, d)))


@query("align_all_ablated", with_(", ".join((ABLATED, NORM, TOKENS, STEPS, CHAINS)), PATHS))
def _(s, d):
    return _paths(align.alignments(_prepared(s, d, True)))


@query("align_all_joins", with_(ALL, PATHS))
def _(s, d):
    src, tgt = _met_tokens(s, d)
    return _paths(align.enumerate_chains(align.candidates(align.collapsed_steps(tgt, src, "pair_id"), src, "pair_id"), "pair_id"))


@query("align_all_tokens", with_(ALL, "SELECT a.pair_id, a.alignment_id, x.k - 1 AS step, s.pos, s.tok AS token, s.start_idx, s.start_idx + length(s.tok) AS end_idx FROM aln a, unnest(a.path) WITH ORDINALITY AS x(p, k) JOIN s ON s.pair_id = a.pair_id AND s.pos = x.p"))
def _(s, d):
    each = align.alignments(_with_starts(s, d), objects=True).select("pair_id", "alignment_id", F.posexplode(F.arrays_zip("path", "starts", "tokens")).alias("step", "t"))
    return _longs(each.select("pair_id", "alignment_id", "step", F.col("t.path").alias("pos"), F.col("t.tokens").alias("token"), F.col("t.starts").alias("start_idx"), (F.col("t.starts") + F.length("t.tokens")).alias("end_idx")))


@query("align_single", with_(BASE, "SELECT pair_id, array_to_string(first, ',') AS path FROM base"))
def _(s, d):
    return _prepared(s, d).select("pair_id", _text("first").alias("path"))


@query("align_count", with_(BASE, "SELECT pair_id, n FROM base"))
def _(s, d):
    return _prepared(s, d).select("pair_id", _count().alias("n"))


@query("align_start_set", with_(BASE, "SELECT pair_id, CASE WHEN len(starts) = 0 THEN '-1' ELSE array_to_string(starts, ',') END AS starts FROM base"))
def _(s, d):
    return _prepared(s, d).withColumn("starts", _starts()).select("pair_id", F.when(F.size("starts") == 0, "-1").otherwise(_text("starts")).alias("starts"))


@query("align_naive", with_(PAIRS, "SELECT pair_id, instr(source, target) - 1 AS start_idx, instr(source, target) - 1 + length(target) AS end_idx FROM pairs WHERE instr(source, target) > 0"))
def _(s, d):
    return _longs(fixture.pairs(s, d).select("pair_id", F.explode(baselines.naive()).alias("t")).select("pair_id", "t.start_idx", "t.end_idx"))


@query("align_lcs")
def _(s, d):
    return _prepared(s, d, True).select("pair_id", baselines.align_lcs("src", text.words(text.norm_text("target"))).alias("path"))


@query("align_difflib")
def _(s, d):
    return _prepared(s, d, True).select("pair_id", baselines.align_difflib("src", text.words(text.norm_text("target"))).alias("path"))


def _word_pairs(s: SparkSession, d: str, ablated: bool = False) -> DataFrame:
    """Prepared pairs with what ``baselines.sweep`` needs, over words; ``gold`` is where the target's first word begins."""
    p = _prepared(s, d, ablated).withColumn("tgt", text.words(text.norm_text("target"))).withColumn("shown", F.col("src"))
    return p.withColumn("starts_at", spans.token_starts(F.col("src"), fixture.lead())).withColumn("gold", F.get("starts_at", 2).cast("int"))


def _subword_pairs(s: SparkSession, d: str, ablated: bool = False) -> DataFrame:
    """The same over subwords. A target takes the space before it, as the words of a text do."""
    arrays = tokens.subword_arrays(_bpe())
    p = fixture.pairs(s, d, ablated).withColumn("target", F.concat(F.lit(" "), F.col("target"))).withColumn("ns", text.norm_text("source"))
    gold = F.get(spans.token_starts(text.words("ns"), fixture.lead()), 2).cast("int") - 1
    p = p.withColumn("gold", gold).withColumn("_s", arrays("ns")).withColumn("_t", arrays(text.norm_text("target")))
    p = p.withColumns({"src": F.col("_s.ids"), "tgt": F.col("_t.ids"), "shown": F.col("_s.tokens"), "starts_at": F.col("_s.starts")})
    p = p.withColumn("q", spans.steps(F.col("src"), F.col("tgt"))).withColumn("cand", spans.candidates(F.col("src"), F.col("q")))
    return p.withColumn("first", spans.first_alignment(F.col("cand"))).withColumn("last", spans.last_alignment(F.col("cand"))).drop("_s", "_t")


def _methods(pairs: DataFrame, separator: str) -> DataFrame:
    """A row for each pair and method: whether it found the true place, and gave the target back."""
    # our own method is asked for all starts, the others give one
    own = pairs.withColumn("all_starts", F.transform(_starts(), lambda i: F.get("starts_at", i).cast("int")))
    out = baselines.sweep(own, separator=separator, keep=("target", "gold", "all_starts"))
    out = out.withColumn("found", F.when(F.col("method") == "custom", F.array_contains("all_starts", F.col("gold"))).otherwise(F.col("start_idx") == F.col("gold")))
    return out.select("pair_id", "method", "start_idx", "text", "found", (F.trim("text") == F.trim("target")).alias("same"))


@query("method_sweep")
def _(s, d):
    return _methods(_word_pairs(s, d, True), " ")


@query("method_sweep_subwords")
def _(s, d):
    return _methods(_subword_pairs(s, d, True), "")


@query("accuracy_of_methods")
def _(s, d):
    """Percentages found and given back, over the contiguous and the ablated pairs, by words and by subwords."""
    parts = [_methods(make(s, d, ablated), separator).withColumns({"mode": F.lit(mode), "ablated": F.lit(ablated)}) for mode, make, separator in (("word", _word_pairs, " "), ("subword", _subword_pairs, "")) for ablated in (False, True)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return _rounded(rows.groupBy("mode", "ablated", "method").agg(F.count("*").alias("n"), evaluate.percent("found").alias("found"), evaluate.percent("same").alias("same")))


@query("subword_means")
def _(s, d):
    return _rounded(_subword_pairs(s, d).agg(F.count("*").alias("n_pairs"), F.avg(F.size("src")).alias("mean_source_subwords"), F.avg(F.size("tgt")).alias("mean_target_subwords")))


@query("benchmark_containment", "SELECT doc_id, item_id, instr(d.text, b.text) - 1 AS start_idx FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def _(s, d):
    found = evaluate.containment(_docs(s, d).select("doc_id", "text"), table(s, d, "benchmark").select("item_id", F.col("text").alias("passage")))
    return found.select("doc_id", "item_id", F.col("start_idx").cast("bigint").alias("start_idx"))


# --------------------------------------------------------------------------------------------------------------- rendering

TOK_OF_FIRST = BASE + """, ft AS (
  SELECT base.pair_id, x.k, s.tok, s.start_idx AS a, s.start_idx + length(s.tok) AS z, base.ns FROM base, unnest(base.first) WITH ORDINALITY AS x(p, k) JOIN s ON s.pair_id = base.pair_id AND s.pos = x.p
)"""


@query("reconstruct_by_token", with_(TOK_OF_FIRST, "SELECT pair_id, string_agg(tok, ' ' ORDER BY k) AS target FROM ft GROUP BY pair_id"))
def _(s, d):
    return _first_tokens(_prepared(s, d)).select("pair_id", _present(render.by_token(F.col("tokens"), " ")).alias("target"))


@query("reconstruct_by_idx", with_(TOK_OF_FIRST, "SELECT pair_id, string_agg(substr(ns, a + 1, z - a), '' ORDER BY k) AS target FROM ft GROUP BY pair_id"))
def _(s, d):
    return _first_tokens(_prepared(s, d)).select("pair_id", _present(render.by_index(F.col("ns"), F.col("tokens"))).alias("target"))


@query("highlight_first", with_(TOK_OF_FIRST, "SELECT pair_id, string_agg(substr(ns, pz + 1, a - pz) || '[[' || tok || ']]', '' ORDER BY k) || substr(any_value(ns), max(z) + 1) AS marked FROM (SELECT *, coalesce(lag(z) OVER (PARTITION BY pair_id ORDER BY k), 0) AS pz FROM ft) GROUP BY pair_id"))
def _(s, d):
    return _first_tokens(_prepared(s, d)).select("pair_id", _present(render.highlight(F.col("ns"), F.col("tokens"), "[[", "]]")).alias("marked"))


@query("span_snippet", with_(PAIRS, "SELECT pair_id, substr(source, lo + 1, hi - lo) || chr(10) || repeat(' ', i - lo) || '^' AS snippet FROM (SELECT *, greatest(i - pad, 0) AS lo, least(i + length(target) + pad, length(source)) AS hi FROM (SELECT pair_id, source, target, instr(source, target) - 1 AS i, least(greatest(length(target), 30), 80) AS pad FROM pairs WHERE instr(source, target) > 0))"))
def _(s, d):
    p = fixture.pairs(s, d).withColumn("i", text.find("source", "target")).where("i >= 0")
    return p.select("pair_id", render.snippet(F.col("source"), F.col("i"), F.col("target")).alias("snippet"))


@query("tokens_in_window", with_(PAIRS + ", " + NORM + ", " + TOKENS, "SELECT pair_id, pos, tok AS token FROM s WHERE start_idx < 60 AND start_idx + length(tok) > 20"))
def _(s, d):
    src = _src_tokens(s, d)
    windows = fixture.pairs(s, d).select("pair_id", F.lit(20).alias("lo"), F.lit(60).alias("hi"))
    return _longs(tokens.in_window(src, windows, "pair_id").select("pair_id", "pos", "token"))


# ----------------------------------------------------------------------------------------------------------------- dataset


@query("flatten_conversations", "SELECT conv_id, turn, role, text FROM conversations")
def _(s, d):
    nested = table(s, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    return nested.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.*")


COLS = "pair_id, kind, source, target, idx_start"


def _naive(s, d):
    return dataset.keep_naive(fixture.records(s, d))


def _dedup(s, d):
    return dataset.dedupe(_naive(s, d), ORDER)


def _clean(s, d):
    return dataset.len_preserved(_dedup(s, d))


@query("keep_naive", with_(NAIVE, f"SELECT {COLS} FROM naive"))
def _(s, d):
    return _longs(_naive(s, d))


@query("dedupe_pairs", with_(DEDUP, f"SELECT {COLS} FROM dedup"))
def _(s, d):
    return _longs(_dedup(s, d))


@query("len_preserved_pairs", with_(CLEAN, f"SELECT {COLS} FROM clean"))
def _(s, d):
    return _longs(_clean(s, d))


@query("shift_pairs", with_(SHIFTED, f"SELECT {COLS}, idx_start_orig, target_orig FROM shifted"))
def _(s, d):
    return _longs(dataset.shift(_clean(s, d)))


@query("row_ids", with_(CLEAN, "SELECT pair_id, kind, row_number() OVER (ORDER BY pair_id, kind) - 1 AS row_id FROM clean"))
def _(s, d):
    return _longs(dataset.add_row_id(_clean(s, d), ORDER).select("pair_id", "kind", "row_id"))


@query("min_words_pairs", with_(RECORDS, f"SELECT {COLS} FROM records WHERE len({sql_words(sql_squash('target'))}) > 2"))
def _(s, d):
    return _longs(dataset.min_words(fixture.records(s, d)))


@query("semi_keep_ids", with_(SHIFTED, f"SELECT {COLS} FROM clean SEMI JOIN (SELECT pair_id, kind FROM shifted WHERE len({sql_words(sql_squash('target'))}) > 2) USING (pair_id, kind)"))
def _(s, d):
    clean = _clean(s, d)
    return _longs(dataset.semi_keep(clean, dataset.min_words(dataset.shift(clean)), ORDER).select("pair_id", "kind", "source", "target", "idx_start"))


@query("group_idx_set", with_(RECORDS, "SELECT source, target, array_to_string(list_sort(list_distinct(list(idx_start))), ',') AS idx_start FROM records GROUP BY source, target"))
def _(s, d):
    return dataset.group_starts(fixture.records(s, d)).withColumn("idx_start", _text("idx_start"))


@query("aligned_lookup", with_(SHIFTED, ", tdf AS (SELECT source, target, array_to_string(list_sort(list_distinct(list(idx_start))), ',') AS a FROM shifted GROUP BY ALL), wdf AS (SELECT source, target, array_to_string(list_sort(list_distinct(list(idx_start))), ',') AS b FROM clean GROUP BY ALL) SELECT tdf.source, tdf.target, a AS idx_start, b AS clean_starts FROM tdf JOIN wdf ON tdf.source = wdf.source AND trim(tdf.target, ' ') = wdf.target"))
def _(s, d):
    clean = _clean(s, d)
    out = dataset.aligned_lookup(dataset.group_starts(dataset.shift(clean)), dataset.group_starts(clean))
    return out.select("source", "target", _text("idx_start").alias("idx_start"), _text("clean_starts").alias("clean_starts"))


@query("split_funnel", with_(SHIFTED, f"SELECT (SELECT count(*) FROM records) AS n_raw, (SELECT count(*) FROM naive) AS n_naive, (SELECT count(*) FROM dedup) AS n_dedup, count(*) AS n_len_ok, count_if(idx_start <> idx_start_orig) AS n_shifted, count_if(substr(source, idx_start + 1, length(target)) <> target) AS n_span_bad, {SHIFT_RULE} AS shift_rule_ok FROM shifted").replace("count_if(", "count(*) FILTER (WHERE "))
def _(s, d):
    return dataset.funnel(fixture.records(s, d), ORDER)


@query("span_mismatches", with_(RECORDS, "SELECT pair_id, kind FROM records WHERE substr(source, idx_start + 2, length(target)) <> target"))
def _(s, d):
    return _longs(dataset.span_mismatches(fixture.records(s, d).withColumn("idx_start", F.col("idx_start") + 1)).select("pair_id", "kind"))


@query("shift_rule_ok", with_(SHIFTED, f"SELECT {SHIFT_RULE} AS ok FROM shifted"))
def _(s, d):
    return dataset.shift(_clean(s, d)).agg(dataset.shift_rule().alias("ok"))


@query("ablate_words", with_(LINES, f"SELECT pair_id, array_to_string(list_concat(t[1:k], t[k + 2:]), ' ') AS target, k AS ablate_idx FROM (SELECT pair_id, w[3:8] AS t, 1 + {_bucket('pair_id', '4')} AS k FROM para)"))
def _(s, d):
    target, at = dataset.ablate_word(F.col("target"), F.col("pair_id"))
    return _longs(fixture.pairs(s, d).select("pair_id", target.alias("target"), at.alias("ablate_idx")))


@query("ablate_subwords")
def _(s, d):
    p = fixture.pairs(s, d).select("pair_id", dataset.ablate_subword(_bpe())(text.norm_text("target"), text.pair_key()).alias("a"))
    return p.select("pair_id", "a.target", F.col("a.idx").alias("ablate_idx"))


@query("pair_hashes", with_(PAIRS, "SELECT pair_id, substr(sha256(source), 1, 7) AS short, substr(sha256(source || chr(10) || '---' || chr(10) || trim(target, ' ')), 1, 12) AS pair_key FROM pairs"))
def _(s, d):
    return fixture.pairs(s, d).select("pair_id", text.short_hash("source").alias("short"), text.pair_key().alias("pair_key"))


@query("union_splits", with_(PAIRS, "SELECT pair_id, source, target, CASE WHEN pair_id % 5 = 0 THEN 'dev' ELSE 'train' END AS split FROM pairs"))
def _(s, d):
    p = fixture.pairs(s, d)
    return dataset.by_split({"train": p.where("pair_id % 5 <> 0"), "dev": p.where("pair_id % 5 = 0")})


# -------------------------------------------------------------------------------------------------------------- evaluation


@query("set_ops_starts", with_(SCORED, "SELECT pair_id, CAST(NOT custom_found AS BIGINT) AS custom_l, CAST(custom_found AS BIGINT) AS custom_x, len(list_filter(custom_starts, lambda x: x <> gold)) AS custom_r, array_to_string(list_filter(custom_starts, lambda x: x <> gold), ',') AS custom_rv, custom_found FROM scored"))
def _(s, d):
    out = evaluate.set_operations(scored(s, d).withColumn("real", F.array("gold")).drop("custom_found"), "real", "custom_starts", "custom")
    return out.select("pair_id", *[F.col(f"custom_{x}").cast("bigint").alias(f"custom_{x}") for x in "lxr"], _text("custom_rv").alias("custom_rv"), "custom_found")


@query("found_same_flags", with_(SCORED, f"SELECT pair_id, {', '.join(FLAGS)} FROM scored"))
def _(s, d):
    return scored(s, d).select("pair_id", *FLAGS)


def _avgs(prefix: str = "avg(CASE WHEN {0} THEN 100.0 ELSE 0 END)") -> str:
    return ", ".join(_r(prefix.format(f), f) for f in FLAGS)


BUCKETS = SCORED + ", b AS (SELECT n_tokens, count(*) AS n, " + ", ".join(f"avg(CASE WHEN {f} THEN 100.0 ELSE 0 END) AS {f}" for f in FLAGS) + " FROM scored GROUP BY n_tokens)"


@query("accuracy_micro", with_(SCORED, f"SELECT {_avgs()} FROM scored"))
def _(s, d):
    return _rounded(evaluate.micro(scored(s, d), FLAGS))


@query("accuracy_by_bucket", with_(BUCKETS, "SELECT n_tokens, n, " + ", ".join(_r(f, f) for f in FLAGS) + " FROM b"))
def _(s, d):
    return _longs(_rounded(evaluate.by_bucket(scored(s, d), "n_tokens", FLAGS)))


@query("accuracy_macro", with_(BUCKETS, f"SELECT {_avgs('avg({0})')} FROM b"))
def _(s, d):
    return _rounded(evaluate.macro(scored(s, d), "n_tokens", FLAGS))


@query("bucket_lookup", with_(BUCKETS, f"SELECT pair_id, scored.n_tokens, {_r('b.custom_found', 'custom_found_bucket')} FROM scored LEFT JOIN b USING (n_tokens)"))
def _(s, d):
    return _longs(_rounded(evaluate.bucket_lookup(scored(s, d), "n_tokens", FLAGS).select("pair_id", "n_tokens", "custom_found_bucket")))


@query("min_accuracy_below", with_(BUCKETS, f"SELECT {_avgs('min({0})')} FROM b WHERE n_tokens <= 60"))
def _(s, d):
    return _rounded(evaluate.least_below(scored(s, d), "n_tokens", FLAGS, 60))


@query("contingency_cube", with_(SCORED, f"SELECT custom_found, naive_found, count(*) AS n, {_r('count(*) * 100.0 / (SELECT count(*) FROM scored)', 'percent')} FROM scored GROUP BY CUBE (custom_found, naive_found)"))
def _(s, d):
    return _rounded(evaluate.contingency(scored(s, d), "custom_found", "naive_found").withColumn("percent", F.col("percent").cast("double")))


def _multimap_sql(base: str) -> str:
    return with_(base, f"SELECT count(*) AS n_pairs, count(*) FILTER (WHERE n > 1) AS n_multimap, {_r('avg(CASE WHEN n > 1 THEN 1.0 ELSE 0 END)', 'frac_multimap')}, max(n) AS max_alignments, {_r('avg(n)', 'mean_alignments')}, {_r('median(n)', 'median_alignments')}, count(*) FILTER (WHERE n = 0) AS n_zero, {_r('avg(CASE WHEN n = 0 THEN 1.0 ELSE 0 END)', 'frac_zero')} FROM base")


@query("multimap_summary", _multimap_sql(BASE))
def _(s, d):
    return _rounded(evaluate.multimap(_prepared(s, d).withColumn("n", _count()), "n"))


@query("multimap_summary_ablated", _multimap_sql(BASE_ABLATED))
def _(s, d):
    return _rounded(evaluate.multimap(_prepared(s, d, True).withColumn("n", _count()), "n"))


@query("describe_alignments", with_(BASE, f"SELECT count(n) AS count, {_r('avg(n)', 'mean')}, {_r('stddev_samp(n)', 'std')}, {_r('min(n)', 'min')}, {', '.join(_r(f'quantile_cont(n, {q / 100})', f'p{q}') for q in (25, 50, 75))}, {_r('max(n)', 'max')} FROM base"))
def _(s, d):
    return _rounded(evaluate.describe(_prepared(s, d).withColumn("n", _count()), "n"))


@query("pair_summary", with_(BASE, f"SELECT count(*) AS n_pairs, count(*) FILTER (WHERE n = 0) AS n_zero, {_r('avg(CASE WHEN n > 0 THEN n END)', 'mean_align')}, {_r('avg(length(source))', 'mean_source_chars')}, {_r(f'avg(len({sql_words("source")}))', 'mean_source_ws')}, {_r('avg(length(target))', 'mean_target_chars')}, {_r(f'avg(len({sql_words("target")}))', 'mean_target_ws')} FROM base"))
def _(s, d):
    return _rounded(evaluate.pair_summary(_prepared(s, d).withColumn("n", _count()), "n"))


@query("text_stats", f"SELECT count(*) AS n_samples, {_r('avg(length(text))', 'chars')}, {_r(f'avg(len({sql_words(sql_squash("text"))}))', 'words')} FROM (SELECT DISTINCT text FROM documents)")
def _(s, d):
    return _rounded(evaluate.text_statistics(_docs(s, d), "text"))


@query("distinct_text_counts", with_(PAIRS, "SELECT count(DISTINCT source) AS sources, count(DISTINCT target) AS targets, count(*) AS pairs FROM pairs"))
def _(s, d):
    return fixture.pairs(s, d).agg(F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets"), F.count("*").alias("pairs"))


@query("reverse_cdf", with_(BASE, "SELECT row_number() OVER (ORDER BY n DESC) AS rank, n FROM base"))
def _(s, d):
    return evaluate.reverse_cdf(_prepared(s, d).select("pair_id", _count().alias("n")), "n", "pair_id")


@query("length_histogram", f"WITH v AS (SELECT length(text)::DOUBLE AS x FROM documents), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v) SELECT CAST(CASE WHEN lo = hi THEN 1 ELSE least(floor((x - lo) * 20 / (hi - lo)) + 1, 20) END AS BIGINT) AS bin, count(*) AS n FROM v, e GROUP BY 1")
def _(s, d):
    return evaluate.histogram(_docs(s, d).select(F.length("text").alias("x")), "x", 20)


@query("coverage_by_length", with_(SCORED, f"SELECT n_target, count(*) AS n, {_r('avg(coverage)', 'coverage')} FROM scored GROUP BY n_target"))
def _(s, d):
    return _longs(_rounded(scored(s, d).groupBy("n_target").agg(F.count("*").alias("n"), F.avg("coverage").alias("coverage"))))


@query("mean_sem_by_length", with_(BASE, f"SELECT len(src) AS n_tokens, count(*) AS n, {_r('avg(base.n)', 'mean')}, {_r('stddev_samp(base.n) / sqrt(count(*))', 'sem')} FROM base GROUP BY 1"))
def _(s, d):
    p = _prepared(s, d).select(F.size("src").alias("n_tokens"), _count().cast("double").alias("y"))
    return _longs(_rounded(evaluate.mean_and_error(p, "n_tokens", "y")))


XY = "xy AS (SELECT CAST(length(text) AS DOUBLE) AS x, CAST(len(string_split(text, ' ')) AS DOUBLE) AS y FROM documents)"
FIT = "fit AS (SELECT pow(10, regr_intercept(log10(y), log10(x))) AS a, regr_slope(log10(y), log10(x)) AS b, min(x) AS x_min, max(x) AS x_max FROM xy WHERE x > 0 AND y > 0)"


def _xy(s, d):
    return _docs(s, d).select(F.length("text").cast("double").alias("x"), F.size(F.split("text", " ")).cast("double").alias("y"))


@query("power_law_fit", f"WITH {XY}, {FIT} SELECT {_r('a', 'a')}, {_r('b', 'b')}, {_r('x_min', 'x_min')}, {_r('x_max', 'x_max')} FROM fit")
def _(s, d):
    return _rounded(evaluate.power_law(_xy(s, d), "x", "y"))


@query("power_law_grid", f"WITH {XY}, {FIT} SELECT k, round(x, 3) AS x, round(a * pow(x, b), 3) AS y FROM (SELECT *, pow(10, log10(x_min) + k * (log10(x_max) - log10(x_min)) / 499) AS x FROM fit, (SELECT unnest(range(500)) AS k))")
def _(s, d):
    return _longs(_rounded(evaluate.power_grid(evaluate.power_law(_xy(s, d), "x", "y"), 500), 3))


# ------------------------------------------------------------------------------------------------------------ further forms


@query("token_strings", with_(PAIRS + ", " + NORM, "SELECT pair_id, array_to_string(src, '|') AS tokens FROM norm"))
def _(s, d):
    structs = F.transform(text.words(text.norm_text("source")), lambda w: F.struct(w.alias("token")))
    return fixture.pairs(s, d).select("pair_id", F.array_join(tokens.token_strings(structs), "|").alias("tokens"))


@query("ngram_graph_k1")
def _(s, d):
    """Every two different words of a pair, as the definition has it for k = 1; the tests hold it against brute force."""
    return _longs(tokens.text_graph(fixture.pairs(s, d), "pair_id", "source", 1))


#: The same alignment CTEs with 2-grams in the place of words.
GRAMS = TOKENS.replace("s AS MAT", "s1 AS MAT", 1).replace("t AS MAT", "t1 AS MAT", 1) + """, s AS MATERIALIZED (SELECT pair_id, pos, tok || ' ' || nx AS tok, nx FROM (SELECT pair_id, pos, tok, lead(tok) OVER (PARTITION BY pair_id ORDER BY pos) AS nx FROM s1) WHERE nx IS NOT NULL),
t AS MATERIALIZED (SELECT pair_id, i, tok || ' ' || nx AS tok FROM (SELECT pair_id, i, tok, lead(tok) OVER (PARTITION BY pair_id ORDER BY i) AS nx FROM t1) WHERE nx IS NOT NULL)"""


@query("kgram_alignment_tokens", with_(", ".join((PAIRS, NORM, GRAMS, STEPS, CHAINS)), "SELECT a.pair_id, a.alignment_id, string_agg(CASE WHEN x.k = 1 THEN s.tok ELSE s.nx END, ' ' ORDER BY x.k) AS tokens FROM aln a, unnest(a.path) WITH ORDINALITY AS x(p, k) JOIN s ON s.pair_id = a.pair_id AND s.pos = x.p GROUP BY a.pair_id, a.alignment_id"))
def _(s, d):
    """Alignments of the target's 2-grams among the source's, as token sequences."""
    grams = lambda c: F.when(F.size(c) > 1, F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.array_join(F.slice(c, i + 1, 2), " "))).otherwise(F.array().cast("array<string>"))
    p = fixture.pairs(s, d).select("pair_id", text.norm_text("source").alias("ns"), text.norm_text("target").alias("nt"))
    p = p.select("pair_id", F.array_remove(F.split("ns", " "), "").alias("w"), F.array_remove(F.split("nt", " "), "").alias("t"))
    p = p.select("pair_id", grams(F.col("w")).alias("src"), grams(F.col("t")).alias("t")).withColumn("q", spans.steps(F.col("src"), F.col("t")))
    p = p.withColumn("cand", spans.candidates(F.col("src"), F.col("q"))).withColumn("starts_at", F.transform("src", lambda x, i: i))
    out = align.alignments(p, objects=True)
    # all tokens of the first gram, only the last one of each later one
    return out.select("pair_id", "alignment_id", F.array_join(F.transform("tokens", lambda g, i: F.when(i == 0, g).otherwise(F.substring_index(g, " ", -1))), " ").alias("tokens"))


@query("highlight_all", with_(ALL + """, av AS (
  SELECT a.pair_id, a.alignment_id, x.k, s.tok, s.start_idx AS a, s.start_idx + length(s.tok) AS z, norm.ns FROM aln a, unnest(a.path) WITH ORDINALITY AS x(p, k) JOIN s ON s.pair_id = a.pair_id AND s.pos = x.p JOIN norm ON norm.pair_id = a.pair_id
), m AS (
  SELECT pair_id, alignment_id, string_agg(substr(ns, pz + 1, a - pz) || '[[' || tok || ']]', '' ORDER BY k) || substr(any_value(ns), max(z) + 1) AS marked
  FROM (SELECT *, coalesce(lag(z) OVER (PARTITION BY pair_id, alignment_id ORDER BY k), 0) AS pz FROM av) GROUP BY pair_id, alignment_id
)""", "SELECT pair_id, string_agg(marked, '' ORDER BY alignment_id) AS marked FROM m GROUP BY pair_id"))
def _(s, d):
    return render.highlighted_all(_with_starts(s, d), "pair_id", "[[", "]]")


@query("alignments_json", with_(ALL, "SELECT a.pair_id, a.alignment_id, string_agg(s.tok || '@' || s.start_idx, ' ' ORDER BY x.k) AS tokens FROM aln a, unnest(a.path) WITH ORDINALITY AS x(p, k) JOIN s ON s.pair_id = a.pair_id AND s.pos = x.p GROUP BY a.pair_id, a.alignment_id"))
def _(s, d):
    """Alignments written as JSON and parsed again."""
    each = align.alignments(_with_starts(s, d), objects=True)
    objects = F.transform(F.arrays_zip("starts", "tokens"), lambda t: F.struct(t["tokens"].alias("token"), t["tokens"].alias("enc_token"), t["starts"].alias("start_idx"), (t["starts"] + F.length(t["tokens"])).alias("end_idx")))
    out = each.select("pair_id", "alignment_id", F.to_json(objects).alias("json"))
    back = F.from_json("json", "array<struct<token:string,enc_token:string,start_idx:int,end_idx:int>>")
    return _longs(out.select("pair_id", "alignment_id", F.array_join(F.transform(back, lambda t: F.concat(t["token"], F.lit("@"), t["start_idx"].cast("string"))), " ").alias("tokens")))


@query("largest_multimaps", with_(BASE, "SELECT pair_id, n FROM base ORDER BY n DESC, pair_id LIMIT 20"))
def _(s, d):
    return _prepared(s, d).select("pair_id", _count().alias("n")).orderBy(F.desc("n"), "pair_id").limit(20)


@query("distinct_tokens", with_(PAIRS + ", " + NORM, "SELECT pair_id, len(list_distinct(src)) AS n_distinct, len(src) AS n FROM norm"))
def _(s, d):
    src = text.words(text.norm_text("source"))
    return _longs(fixture.pairs(s, d).select("pair_id", F.size(F.array_distinct(src)).alias("n_distinct"), F.size(src).alias("n")))


@query("sources_in_both_splits", with_(PAIRS, "SELECT source FROM pairs WHERE pair_id % 5 <> 0 INTERSECT SELECT source FROM pairs WHERE pair_id % 5 = 0"))
def _(s, d):
    p = fixture.pairs(s, d)
    return p.where("pair_id % 5 <> 0").select("source").intersect(p.where("pair_id % 5 = 0").select("source"))


@query("sources_in_train_only", with_(PAIRS, "SELECT source FROM pairs WHERE pair_id % 5 <> 0 EXCEPT SELECT source FROM pairs WHERE pair_id % 5 = 0"))
def _(s, d):
    p = fixture.pairs(s, d)
    return p.where("pair_id % 5 <> 0").select("source").subtract(p.where("pair_id % 5 = 0").select("source"))


@query("pair_summary_ablated", ORACLE_SQL["pair_summary"].replace(PAIRS, ABLATED))
def _(s, d):
    return _rounded(evaluate.pair_summary(_prepared(s, d, True).withColumn("n", _count()), "n"))


@query("frame_shapes", with_(SHIFTED, "SELECT count(*) AS n_rows, count(DISTINCT source) AS n_sources, count(DISTINCT target) AS n_targets FROM (SELECT source, target FROM shifted GROUP BY source, target)"))
def _(s, d):
    frame = dataset.group_starts(dataset.shift(_clean(s, d)))
    return frame.agg(F.count("*").alias("n_rows"), F.count_distinct("source").alias("n_sources"), F.count_distinct("target").alias("n_targets"))
