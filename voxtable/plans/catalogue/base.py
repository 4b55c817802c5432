"""Registry, input tables and shared SQL parts of the query catalogue."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from voxtable.functions import lexicons as lex, text as tx
from voxtable.operators import counting, expansion, labeling, sampling, tfidf
from voxtable.operators.rows import exploded
from voxtable.sources.corpus import with_columns_from_documents
from voxtable.sources.scratch import materialize, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Topic and polarity words that occur in the invented prose of the test tables.
CORPUS_LEXICON = {
    "performance": ["thon", "erin", "que"],
    "usability": ["thth", "thre", "aux", "und"],
    "features": ["thing", "onan", "des", "nicht"],
    "pricing": ["erst", "attion", "les", "von"],
    "support": ["ernd", "thble", "para", "mit"],
    "compatibility": ["anan", "ersh", "los", "der"],
}
CORPUS_POLARITY = {
    "thon": 1.9, "erin": 2.5, "que": 1.2, "und": 1.5, "los": 1.4, "thing": 0.8, "the": 0.3,
    "thth": -1.7, "erst": -2.2, "des": -1.3, "von": -1.1, "para": -1.9, "anan": -0.9, "of": -0.4,
}
CORPUS_TERMS = ["thon", "que", "nicht", "para", "erin", "thing"]


class Tables:
    """The given tables as review-shaped inputs."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def reviews(self) -> DataFrame:
        return with_columns_from_documents(spread(self.table("documents"), "doc_id"))

    @cached_property
    def labeled(self) -> DataFrame:
        return labeling.auto_label(self.reviews, CORPUS_LEXICON)

    @cached_property
    def with_sentences(self) -> DataFrame:
        return self.reviews.withColumn("sentences", tx.sentences("text"))

    @cached_property
    def queries(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))

    @cached_property
    def turns(self) -> DataFrame:
        """Conversation turns as a larger table of queries."""
        return spread(self.table("conversations"), "conv_id").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"), "conv_id", "turn")

    @cached_property
    def query_terms(self) -> DataFrame:
        return self.queries.select("query_id", tx.whitespace_words(F.lower("query")).alias("terms"))

    @cached_property
    def polarity(self) -> DataFrame:
        from voxtable.sources.scratch import literal_table

        return literal_table(self.spark, {"word": list(CORPUS_POLARITY), "valence": list(CORPUS_POLARITY.values())})

    @cached_property
    def word_totals(self) -> DataFrame:
        """(term, total, df) of every word of two characters or more, counted once for the term cache and the synonyms."""
        return materialize(counting.word_totals(self.reviews, stop_words=[]), "corpus-words")

    @cached_property
    def term_cache(self) -> DataFrame:
        """Verdicts on corpus terms: relevant when the number of documents is even."""
        return self.word_totals.where(F.col("df") > 1).select("term", (F.col("df") % 2 == 0).alias("is_relevant"))

    @cached_property
    def synonyms(self) -> DataFrame:
        """Frequent corpus words that share their first four letters with a query word."""
        counts = self.word_totals.where(F.col("term").rlike("^[a-z]{4,}$")).select(
            F.col("term").alias("syn"), F.col("total").alias("n"), F.substring("term", 1, 4).alias("family"))
        w = W.partitionBy("family").orderBy(F.desc("n"), "syn")
        best = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 6)
        asked = exploded(self.query_terms, [], "terms", "word").distinct().withColumn("family", F.substring("word", 1, 4))
        return asked.join(best, "family").select("word", "syn", "rank")

    @cached_property
    def judgments(self) -> DataFrame:
        """Stored verdicts on (query, review) pairs."""
        return self.reviews.select((F.col("doc_id") % 20).alias("query_id"), "review_id", (F.col("rating") >= 3).alias("is_relevant"))


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def big(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def joined(c, sep: str = "|") -> Column:
    return F.array_join(F.col(c) if isinstance(c, str) else c, sep)


def shuffle_key() -> list[Column]:
    """An order both engines compute alike."""
    return [(F.col("doc_id") * 7919 + 42) % 100003, F.col("doc_id")]


# ---- SQL parts --------------------------------------------------------------------------------

SHUFFLE = "(doc_id * 7919 + 42) % 100003, doc_id"
WORD = r"\p{L}\p{N}_"
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def sql_list(values) -> str:
    return f"[{quoted(values)}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda w: w <> '')"


def sql_runs(x: str, low: int = 1) -> str:
    return f"regexp_extract_all(lower({x}), '[{WORD}]{{{low},}}')"


def sql_latin(x: str, low: int = 1) -> str:
    return f"list_filter({sql_runs(x)}, lambda w: regexp_full_match(w, '[a-z]{{{low},}}'))"


def sql_has_word(x: str, term: str) -> str:
    return f"regexp_matches(lower({x}), '(^|[^{WORD}]){term}([^{WORD}]|$)')"


def sql_ngrams(ts: str, n: int) -> str:
    return f"[array_to_string({ts}[i:i+{n - 1}], ' ') for i in range(1, len({ts}) - {n - 2})]"


NORMAL = f"trim(regexp_replace(text, '{SPACE}+', ' ', 'g'))"

REVIEWS = """reviews AS (
  SELECT doc_id, printf('R%06d', doc_id) AS review_id, text, CAST(1 + doc_id % 5 AS INTEGER) AS rating,
         substr(text, 1, 40) AS title, source AS product_id, lang FROM documents)"""

CLEAN = f"""usable AS (
  SELECT *, {NORMAL} AS normal, row_number() OVER (PARTITION BY text ORDER BY review_id) AS copy_no FROM reviews),
cleaned AS (
  SELECT doc_id, review_id, normal AS text, rating, title, product_id, lang FROM usable
  WHERE copy_no = 1 AND normal <> '' AND length(normal) BETWEEN 10 AND 5000 AND rating BETWEEN 1 AND 5)"""

SENTENCES = f"""sents AS (
  SELECT doc_id, review_id, text, rating, list_filter(list_transform(string_split(
    regexp_replace(regexp_replace(translate(text, chr(30) || chr(29), '  '),
      '(^|[^{WORD}])({'|'.join(lex.ABBREVIATIONS)})\\.', '\\1\\2' || chr(29), 'g'),
      '([.!?]["'')\\]]*){SPACE}+', '\\1' || chr(30), 'g'), chr(30)),
    lambda s: {sql_strip("translate(s, chr(29), '.')")}), lambda s: s <> '') AS sentences FROM reviews)"""


def label_ctes(lexicon: dict, source: str = "reviews", out: str = "labeled") -> str:
    hits = ",\n    ".join(f"list_filter({sql_list(ws)}, lambda k: contains(lower(text), k)) AS h_{t}" for t, ws in lexicon.items())
    top = "greatest(" + ", ".join(f"len(h_{t})" for t in lexicon) + ")"
    label = "CASE WHEN " + top + " = 0 THEN 'other' " + " ".join(f"WHEN len(h_{t}) = {top} THEN '{t}'" for t in lexicon) + " END"
    kws = "CASE topic_label " + " ".join(f"WHEN '{t}' THEN h_{t}" for t in lexicon) + " ELSE CAST([] AS VARCHAR[]) END"
    return f"""{out}_hits AS (SELECT *, {hits} FROM {source}),
{out}_named AS (SELECT *, {label} AS topic_label FROM {out}_hits),
{out} AS (SELECT *, {kws} AS matched_keywords, len({kws}) AS confidence_score FROM {out}_named)"""


LABELED = label_ctes(CORPUS_LEXICON)


def tf_ctes(source: str, key: str, p: str) -> str:
    """{p}_tf: term counts per document of uni- and bigrams without stop words."""
    return f"""{p}_toks AS (
  SELECT {key}, list_filter({sql_runs('text', 2)}, lambda t: t NOT IN ({quoted(lex.SEARCH_STOP_WORDS)})) AS ts FROM {source}),
{p}_tf AS (
  SELECT {key}, term, count(*) AS tf
  FROM (SELECT {key}, unnest(list_concat(ts, {sql_ngrams('ts', 2)})) AS term FROM {p}_toks) GROUP BY {key}, term)"""


def vocab_ctes(p: str, size: int, source: str) -> str:
    return f"""{p}_top AS (
  SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df FROM {p}_tf GROUP BY term ORDER BY total DESC, term LIMIT {size}),
{p}_vocab AS (SELECT term, total, df, ln((1 + (SELECT count(*) FROM {source})) / (1 + df)) + 1 AS idf FROM {p}_top)"""


def weight_ctes(tf: str, vocab: str, key: str, out: str) -> str:
    return f"""{out}_raw AS (SELECT {key}, term, tf * idf AS w FROM {tf} JOIN {vocab} USING (term)),
{out}_norm AS (SELECT {key}, sqrt(sum(w * w)) AS norm FROM {out}_raw GROUP BY {key}),
{out} AS (SELECT r.{key}, term, w / norm AS weight FROM {out}_raw r JOIN {out}_norm n ON r.{key} = n.{key})"""


QUERY_TERMS = f"""asked AS (SELECT item_id AS query_id, text AS query, {sql_words('lower(text)')} AS terms FROM benchmark)"""

INDEX = ",\n".join([REVIEWS, tf_ctes("reviews", "review_id", "d"), vocab_ctes("d", 10000, "reviews"),
                    weight_ctes("d_tf", "d_vocab", "review_id", "postings")])


def score_ctes(terms_source: str, p: str = "q") -> str:
    """{p}_score(query_id, review_id, score) for term lists in ``terms_source``."""
    return f"""{p}_text AS (SELECT query_id, array_to_string(terms, ' ') AS text FROM {terms_source}),
{tf_ctes(f'{p}_text', 'query_id', p)},
{weight_ctes(f'{p}_tf', 'd_vocab', 'query_id', f'{p}_weights')},
{p}_score AS (
  SELECT query_id, review_id, sum(q.weight * d.weight) AS score
  FROM {p}_weights q JOIN postings d USING (term) GROUP BY query_id, review_id)"""


def top_ctes(scores: str, k: int, out: str = "ranked") -> str:
    return f"""{out} AS (
  SELECT * FROM (SELECT query_id, review_id, score,
    row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, review_id) AS rank FROM {scores}) WHERE rank <= {k})"""


def classifier_ctes(train: str, apply: str, classes: list, label: str = "topic_label", size: int = 5000, p: str = "nb") -> str:
    """Naive Bayes fitted on ``train`` and applied to ``apply``: {p}_predicted."""
    order = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(classes))
    return f"""{tf_ctes(train, 'review_id', f'{p}t')},
{vocab_ctes(f'{p}t', size, train)},
{weight_ctes(f'{p}t_tf', f'{p}t_vocab', 'review_id', f'{p}t_w')},
{p}_prior AS (SELECT {label} AS class, ln(count(*) / (SELECT count(*) FROM {train})) AS prior FROM {train} GROUP BY {label}),
{p}_sum AS (SELECT {label} AS class, term, sum(weight) AS f FROM {p}t_w JOIN {train} USING (review_id) GROUP BY {label}, term),
{p}_total AS (SELECT class, sum(f) AS total FROM {p}_sum GROUP BY class),
{p}_logp AS (
  SELECT c.class, v.term, ln((coalesce(s.f, 0) + 1.0::DOUBLE) / (coalesce(t.total, 0) + (SELECT count(*) FROM {p}t_vocab))) AS logp
  FROM {p}_prior c CROSS JOIN {p}t_vocab v LEFT JOIN {p}_sum s ON s.class = c.class AND s.term = v.term
  LEFT JOIN {p}_total t ON t.class = c.class),
{tf_ctes(apply, 'review_id', f'{p}a')},
{weight_ctes(f'{p}a_tf', f'{p}t_vocab', 'review_id', f'{p}a_w')},
{p}_evidence AS (SELECT review_id, class, sum(weight * logp) AS s FROM {p}a_w JOIN {p}_logp USING (term) GROUP BY review_id, class),
{p}_joint AS (
  SELECT a.review_id, c.class, c.prior + coalesce(e.s, 0) AS score, CASE c.class {order} END AS ord
  FROM (SELECT DISTINCT review_id FROM {apply}) a CROSS JOIN {p}_prior c
  LEFT JOIN {p}_evidence e ON e.review_id = a.review_id AND e.class = c.class),
{p}_best AS (SELECT *, max(score) OVER (PARTITION BY review_id) AS best FROM {p}_joint),
{p}_predicted AS (
  SELECT review_id, arg_min(class, ord) FILTER (WHERE round(score, 9) = round(best, 9)) AS predicted_topic,
         1 / sum(exp(score - best)) AS confidence FROM {p}_best GROUP BY review_id)"""


NB = ",\n".join([REVIEWS, LABELED, classifier_ctes("labeled", "reviews", lex.TOPICS)])

# Predictions grouped by product, each product with a topic of its own.
SCORED = NB + f""",
scored AS (
  SELECT product_id AS query_id, review_id, predicted_topic, confidence,
    {sql_list(lex.TOPICS)}[1 + CAST(substr(product_id, 4) AS INTEGER) % 7] AS target_topic
  FROM nb_predicted JOIN reviews USING (review_id))"""

ADJUSTED = " + ".join(
    f"sign(valence) * (CASE WHEN b{k} IN ({quoted(lex.BOOSTERS_UP)}) THEN {0.293 * d!r} "
    f"WHEN b{k} IN ({quoted(lex.BOOSTERS_DOWN)}) THEN {-0.293 * d!r} ELSE 0 END)" for k, d in ((1, 1.0), (2, 0.95), (3, 0.9)))

POLARITY = SENTENCES + f""",
lexicon(word, valence) AS (VALUES {', '.join(f"('{w}', {v}::DOUBLE)" for w, v in CORPUS_POLARITY.items())}),
each_sentence AS (SELECT review_id, unnest(sentences) AS sentence, generate_subscripts(sentences, 1) - 1 AS sentence_no FROM sents),
sentence_words AS (
  SELECT review_id, sentence_no, sentence, regexp_extract_all(lower(sentence), '[{WORD}'']+') AS ws FROM each_sentence),
each_word AS (SELECT review_id, sentence_no, ws, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM sentence_words),
near AS (SELECT review_id, sentence_no, word, CASE WHEN i > 1 THEN ws[i - 1] END AS b1, CASE WHEN i > 2 THEN ws[i - 2] END AS b2,
         CASE WHEN i > 3 THEN ws[i - 3] END AS b3 FROM each_word),
valued AS (
  SELECT review_id, sentence_no, (valence + {ADJUSTED})
    * (CASE WHEN b1 IN ({quoted(lex.NEGATIONS)}) OR b2 IN ({quoted(lex.NEGATIONS)}) OR b3 IN ({quoted(lex.NEGATIONS)})
       THEN -0.74 ELSE 1 END) AS v FROM near JOIN lexicon USING (word)),
sentence_sums AS (SELECT review_id, sentence_no, sum(v) AS v FROM valued GROUP BY review_id, sentence_no),
loud AS (
  SELECT s.review_id, s.sentence_no, coalesce(v, 0.0::DOUBLE) + sign(coalesce(v, 0.0::DOUBLE))
    * least(len(sentence) - len(replace(sentence, '!', '')), 4) * 0.292::DOUBLE AS x
  FROM sentence_words s LEFT JOIN sentence_sums USING (review_id, sentence_no)),
polar AS (SELECT review_id, sentence_no, x / sqrt(x * x + 15) AS polarity FROM loud),
symbols AS (
  SELECT review_id, sentence_no, polarity,
    CASE WHEN polarity < -0.6 THEN 0 WHEN polarity < -0.2 THEN 1 WHEN polarity < 0.2 THEN 2 WHEN polarity < 0.6 THEN 3 ELSE 4 END AS sym,
    CASE WHEN polarity >= 0.2 THEN 'positive' WHEN polarity <= -0.2 THEN 'negative' ELSE 'neutral' END AS state FROM polar)"""

PAIRS = f""",
pairs AS (
  SELECT review_id, sentence_no, state, lead(state) OVER (PARTITION BY review_id ORDER BY sentence_no) AS next_state FROM symbols),
moves AS (SELECT review_id, left(state, 3) AS a, left(next_state, 3) AS b, count(*) AS n FROM pairs WHERE next_state IS NOT NULL GROUP BY ALL),
states3(s) AS (VALUES ('pos'), ('neg'), ('neu')),
move_shares AS (
  SELECT r.review_id, x.s AS a, y.s AS b, coalesce(m.n, 0) AS n,
    coalesce(m.n / sum(m.n) OVER (PARTITION BY r.review_id, x.s), 0) AS share
  FROM (SELECT DISTINCT review_id FROM symbols) r CROSS JOIN states3 x CROSS JOIN states3 y
  LEFT JOIN moves m ON m.review_id = r.review_id AND m.a = x.s AND m.b = y.s)"""

TERM_CACHE = f"""cache AS (
  SELECT term, count(*) % 2 = 0 AS is_relevant
  FROM (SELECT unnest(list_distinct({sql_runs('text', 2)})) AS term FROM documents) GROUP BY term HAVING count(*) > 1)"""

SYNONYMS = f"""syn_counts AS (
  SELECT w AS syn, left(w, 4) AS family, count(*) AS n FROM (SELECT unnest({sql_latin('text', 4)}) AS w FROM documents) GROUP BY w),
syn_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, syn) AS rank FROM syn_counts) WHERE rank <= 6),
syn_raw AS (
  SELECT word, syn, rank FROM (SELECT DISTINCT unnest(terms) AS word FROM asked) a JOIN syn_best b ON b.family = left(a.word, 4)),
synonyms AS (
  SELECT * FROM (SELECT word, syn, row_number() OVER (PARTITION BY word ORDER BY rank, syn) AS rank FROM syn_raw
    WHERE syn <> word AND NOT contains(syn, '_')) WHERE rank <= 5)"""


def _beam_sql(depth: int, width: int) -> str:
    before = f"beam{depth - 1}"
    return f"""spots{depth} AS (
  SELECT query_id, terms, bno, words, path, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM {before}),
cands{depth} AS (
  SELECT query_id, terms, bno, pos, s.rank AS syn_rank, path,
    list_transform(words, lambda w, i: CASE WHEN i = pos THEN s.syn ELSE w END) AS nw
  FROM spots{depth} JOIN synonyms s USING (word)),
scored{depth} AS (
  SELECT *, len(list_filter(list_distinct(nw), lambda x: NOT list_contains(terms, x))) * 0.4::DOUBLE
    + len(list_filter(list_distinct(nw), lambda x: list_contains(terms, x))) / greatest(len(list_distinct(terms)), 1) * 0.5::DOUBLE
    + 0.1::DOUBLE AS score FROM cands{depth}),
beam{depth} AS (
  SELECT query_id, terms, nw AS words, list_append(path, array_to_string(nw, ' ')) AS path, score, bno2 AS bno FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bno, pos, syn_rank) AS bno2 FROM scored{depth})
  WHERE bno2 <= {width})"""


EXPANSION = ",\n".join([QUERY_TERMS, SYNONYMS,
    "beam0 AS (SELECT query_id, terms, terms AS words, [lower(query)] AS path, 1.0::DOUBLE AS score, 1 AS bno FROM asked)",
    _beam_sql(1, 3), _beam_sql(2, 3),
    """paths AS (SELECT query_id, 1 AS depth, bno, path, score FROM beam1 UNION ALL SELECT query_id, 2, bno, path, score FROM beam2),
extra AS (
  SELECT query_id, term, 1 AS part, row_number() OVER (PARTITION BY query_id ORDER BY term) AS pos FROM (
    SELECT DISTINCT query_id, term FROM (SELECT query_id, terms, unnest(words) AS term FROM beam2) WHERE NOT list_contains(terms, term))),
own AS (
  SELECT query_id, term, 0 AS part, min(pos) AS pos FROM (
    SELECT query_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM asked) GROUP BY query_id, term),
expanded_rows AS (SELECT * FROM own UNION ALL SELECT * FROM extra),
expanded AS (SELECT query_id, list(term ORDER BY part, pos) AS terms FROM expanded_rows GROUP BY query_id)"""])

FILTERED = TERM_CACHE + """,
filtered_rows AS (
  SELECT e.query_id, e.term, part, pos FROM expanded_rows e JOIN asked a USING (query_id) LEFT JOIN cache c ON c.term = e.term
  WHERE list_contains(a.terms, e.term) OR coalesce(c.is_relevant, false)),
filtered AS (
  SELECT a.query_id, coalesce(list(f.term ORDER BY part, pos) FILTER (WHERE f.term IS NOT NULL), CAST([] AS VARCHAR[])) AS terms
  FROM asked a LEFT JOIN filtered_rows f USING (query_id) GROUP BY a.query_id)"""
