"""Sentence polarity, sentiment sequences and the hidden Markov model."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.functions import lexicons as lex, text as tx
from voxtable.operators import hmm, sentiment
from voxtable.plans import analyze
from voxtable.plans.catalogue.base import *  # noqa: F403
from voxtable.plans.catalogue.base import query
from voxtable.sources import models
from voxtable.sources.scratch import materialize, scratch_path

SYMBOLS = f"{REVIEWS}, {POLARITY}"


def observed_of(d: Tables):
    return sentiment.observations(d.with_sentences, d.polarity)


@query("j11_sentence_polarity", f"WITH {SYMBOLS} SELECT review_id, CAST(sentence_no AS BIGINT) AS sentence_no, round(polarity, 6) AS polarity FROM polar")
def _(d):
    return sentiment.sentence_polarity(d.with_sentences, d.polarity).select(
        "review_id", big("sentence_no").alias("sentence_no"), r6("polarity").alias("polarity"))


@query("h16_review_polarity", f"""WITH {SYMBOLS} SELECT review_id, round(avg(polarity), 6) AS mean_polarity, round(min(polarity), 6) AS lowest,
  round(max(polarity), 6) AS highest FROM polar GROUP BY review_id""")
def _(d):
    rows = sentiment.sentence_polarity(d.with_sentences, d.polarity)
    return rows.groupBy("review_id").agg(r6(F.avg("polarity")).alias("mean_polarity"), r6(F.min("polarity")).alias("lowest"),
                                         r6(F.max("polarity")).alias("highest"))


@query("h13_symbol", """SELECT event_id, CASE WHEN value / 50 - 1 < -0.6 THEN 0 WHEN value / 50 - 1 < -0.2 THEN 1 WHEN value / 50 - 1 < 0.2 THEN 2
  WHEN value / 50 - 1 < 0.6 THEN 3 ELSE 4 END AS symbol FROM events""")
def _(d):
    return d.table("events").select("event_id", sentiment.symbol(F.col("value") / 50 - 1).alias("symbol"))


@query("h14_symbol_sequence", f"WITH {SYMBOLS} SELECT review_id, string_agg(CAST(sym AS VARCHAR), '' ORDER BY sentence_no) AS symbols FROM symbols GROUP BY review_id")
def _(d):
    return observed_of(d).select("review_id", joined(F.col("symbols").cast("array<string>"), "").alias("symbols"))


STATES = "states AS (SELECT review_id, list(state ORDER BY sentence_no) AS states FROM symbols GROUP BY review_id)"


def sequences_of(d: Tables, model=None):
    return hmm.analyze(observed_of(d), model)


@query("m10_fallback_states", f"WITH {SYMBOLS}, {STATES} SELECT review_id, array_to_string(states, '|') AS states FROM states")
def _(d):
    return sequences_of(d).select("review_id", joined("sentiment_states").alias("states"))


@query("h12_timeline", f"""WITH {SYMBOLS} SELECT review_id, string_agg(CASE state WHEN 'positive' THEN '🟢' WHEN 'negative' THEN '🔴' ELSE '🟡' END, ''
  ORDER BY sentence_no) AS flow FROM symbols GROUP BY review_id""")
def _(d):
    return sequences_of(d).select("review_id", tx.timeline("sentiment_states").alias("flow"))


@query("j03_sequence_cards", f"""WITH {SYMBOLS}, {STATES}, side AS (SELECT * FROM reviews WHERE lang = 'en')
SELECT s.review_id, array_to_string(list_transform(states, lambda x: CASE x WHEN 'positive' THEN '🟢' WHEN 'negative' THEN '🔴' ELSE '🟡' END), '') AS flow,
  coalesce(repeat('★', rating) || repeat('☆', 5 - rating), '') AS stars,
  coalesce(CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END, '') AS head
FROM states s LEFT JOIN side r USING (review_id) WHERE len(states) > 1""")
def _(d):
    return analyze.sequence_cards(sequences_of(d), d.reviews.where(F.col("lang") == "en"))


@query("w05_next_states", f"""WITH {SYMBOLS}{PAIRS} SELECT review_id, CAST(sentence_no AS BIGINT) AS sentence_no, left(state, 3) || '_to_' || left(next_state, 3) AS step
FROM pairs WHERE next_state IS NOT NULL""")
def _(d):
    """Next-state pairs read inside each sequence, so no window and no shuffle is needed."""
    steps = tx.let(F.col("sentiment_states"), lambda ss: F.transform(
        F.slice(ss, 1, F.greatest(F.size(ss) - 1, F.lit(0))), lambda s, i: tx.transition_key(s, F.get(ss, i + 1))))
    rows = sequences_of(d).select("review_id", F.posexplode_outer(steps).alias("sentence_no", "step"))
    return rows.where(F.col("step").isNotNull()).select("review_id", big("sentence_no").alias("sentence_no"), "step")


@query("h15_transition_key", f"""WITH {SYMBOLS}{PAIRS} SELECT left(state, 3) || '_to_' || left(next_state, 3) AS step, count(*) AS n
FROM pairs WHERE next_state IS NOT NULL GROUP BY ALL""")
def _(d):
    counted = sequences_of(d).select(sentiment.transition_counts("sentiment_states").alias("c"))
    sums = counted.agg(*[F.sum(F.get("c", F.lit(k))).alias(f"k{k}") for k in range(9)])
    rows = [F.struct(F.lit(key).alias("step"), F.col(f"k{k}").alias("n")) for k, key in enumerate(sentiment.TRANSITION_KEYS)]
    return sums.select(F.inline(F.array(*rows))).where(F.col("n") > 0)


@query("a16_transitions", f"WITH {SYMBOLS}{PAIRS} SELECT review_id, a || '_to_' || b AS step, round(share, 6) AS share FROM move_shares")
def _(d):
    rows = sequences_of(d).select("review_id", F.explode("transitions").alias("step", "share"))
    return rows.withColumn("share", r6("share"))


NAMED = "CASE {0} WHEN 'pos' THEN 'Positive' WHEN 'neg' THEN 'Negative' ELSE 'Neutral' END"


@query("a17_mean_transitions", f"""WITH {SYMBOLS}{PAIRS}
SELECT {NAMED.format('a')} AS from_state, {NAMED.format('b')} AS to_state, round(avg(share), 6) AS probability FROM move_shares GROUP BY a, b""")
def _(d):
    return sentiment.mean_transitions(sequences_of(d)).withColumn("probability", r6("probability"))


@query("a17_pooled_transitions", f"""WITH {SYMBOLS}{PAIRS}, t AS (SELECT a, b, sum(n) AS n FROM move_shares GROUP BY a, b)
SELECT {NAMED.format('a')} AS from_state, {NAMED.format('b')} AS to_state, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY a), 0), 0), 6) AS probability FROM t""")
def _(d):
    return sentiment.mean_transitions(sequences_of(d), pooled=True).withColumn("probability", r6("probability"))


@query("a30_common_patterns", f"""WITH {SYMBOLS}, {STATES} SELECT array_to_string(states, '>') AS pattern, count(*) AS n FROM states
GROUP BY pattern ORDER BY n DESC, pattern LIMIT 5""")
def _(d):
    return sentiment.common_patterns(sequences_of(d), 5)


# ---- hidden Markov model ----------------------------------------------------------------------

OBS = """seqs AS (SELECT review_id, count(*) AS len FROM symbols GROUP BY review_id),
obs AS MATERIALIZED (SELECT review_id, sentence_no AS t, sym + 1 AS o, len FROM symbols JOIN seqs USING (review_id))"""

# One document in five is held out; the model is trained on the others only.
HELD = "substr(review_id, 2)::BIGINT % 5 = 0"
SPLIT_OBS = (OBS.replace("obs AS", "every_obs AS") + f""",
obs AS MATERIALIZED (SELECT * FROM every_obs WHERE NOT {HELD}), held_obs AS MATERIALIZED (SELECT * FROM every_obs WHERE {HELD})""")


def _lit(p: float) -> str:
    return f"({p!r})::DOUBLE" if p > float("-inf") else "'-inf'::DOUBLE"


def viterbi_ctes() -> str:
    """best_path(review_id, path): digits 0-2, one per sentence, by the one-row model ``trained``."""
    ln = lambda p: f"(CASE WHEN {p} > 0 THEN ln({p}) ELSE '-inf'::DOUBLE END)"
    first = ", ".join(f"{ln(f's{j}')} + {ln(f'b{j}[o]')} AS d{j}, '{j}' AS p{j}" for j in range(3))
    into = lambda i, j: f"(v.d{i} + {ln(f'm.a{i}{j}')})"
    step = []
    for j in range(3):
        best = "greatest(" + ", ".join(into(i, j) for i in range(3)) + ")"
        step.append(f"{best} + {ln(f'm.b{j}[b.o]')} AS d{j}")
        step.append(f"(CASE WHEN {into(0, j)} = {best} THEN v.p0 WHEN {into(1, j)} = {best} THEN v.p1 ELSE v.p2 END) || '{j}' AS p{j}")
    order = ["d0", "p0", "d1", "p1", "d2", "p2"]
    return f"""vit AS (
  SELECT review_id, t, len, {first} FROM obs, trained WHERE t = 0
  UNION ALL
  SELECT b.review_id, b.t, b.len, {', '.join(step)} FROM vit v JOIN obs b ON b.review_id = v.review_id AND b.t = v.t + 1, trained m),
best_path AS (
  SELECT review_id, CASE WHEN d0 >= d1 AND d0 >= d2 THEN p0 WHEN d1 >= d2 THEN p1 ELSE p2 END AS path FROM vit WHERE t = len - 1),
decoded AS (
  SELECT s.review_id, CASE WHEN len(s.states) < 2 THEN s.states
    ELSE list_transform(string_split(b.path, ''), lambda x: CASE x WHEN '0' THEN 'positive' WHEN '1' THEN 'negative' ELSE 'neutral' END) END AS states
  FROM states s JOIN best_path b USING (review_id))"""


def forward_ctes(k: int, obs: str = "obs") -> str:
    """f{k}: scaled forward pass over ``obs`` with the one-row parameters par{k}."""
    raw = ", ".join("(" + " + ".join(f"f.x{i} * p.a{i}{j}" for i in range(3)) + f") * p.b{j}[q.o] AS r{j}" for j in range(3))
    first = ", ".join(f"p.s{j} * p.b{j}[q.o] AS r{j}" for j in range(3))
    scaled = "review_id, t, len, o, r0 + r1 + r2 AS c, " + ", ".join(f"r{j} / (r0 + r1 + r2) AS x{j}" for j in range(3))
    return f"""f{k} AS (
  SELECT {scaled} FROM (SELECT q.review_id, q.t, q.len, q.o, {first} FROM {obs} q, par{k} p WHERE q.t = 0 AND q.len > 1)
  UNION ALL
  SELECT {scaled} FROM (SELECT q.review_id, q.t, q.len, q.o, {raw} FROM f{k} f JOIN {obs} q ON q.review_id = f.review_id AND q.t = f.t + 1, par{k} p))"""


def em_ctes(k: int) -> str:
    """One Baum-Welch step: par{k} -> par{k+1}."""
    back = ", ".join("(" + " + ".join(f"p.a{i}{j} * p.b{j}[n.o] * w.y{j}" for j in range(3)) + f") / n.c AS y{i}" for i in range(3))
    xi = ", ".join(f"sum(f.x{i} * p.a{i}{j} * p.b{j}[n.o] * w.y{j} / n.c) AS t{i}{j}" for i in range(3) for j in range(3))
    gam = ", ".join([f"sum(CASE WHEN t = 0 THEN g{i} ELSE 0 END) AS n{i}" for i in range(3)]
                    + [f"sum(CASE WHEN o = {o} THEN g{i} ELSE 0 END) AS e{i}{o}" for i in range(3) for o in range(1, 6)])
    start = ", ".join(f"n{i} / (n0 + n1 + n2) AS s{i}" for i in range(3))
    trans = ", ".join(f"t{i}{j} / (t{i}0 + t{i}1 + t{i}2) AS a{i}{j}" for i in range(3) for j in range(3))
    emit = ", ".join("[" + ", ".join(f"e{i}{o} / (e{i}1 + e{i}2 + e{i}3 + e{i}4 + e{i}5)" for o in range(1, 6)) + f"] AS b{i}" for i in range(3))
    return f"""{forward_ctes(k)},
ff{k} AS MATERIALIZED (SELECT * FROM f{k}),
w{k} AS (
  SELECT review_id, t, 1.0::DOUBLE AS y0, 1.0::DOUBLE AS y1, 1.0::DOUBLE AS y2 FROM ff{k} WHERE t = len - 1
  UNION ALL
  SELECT w.review_id, w.t - 1, {back} FROM w{k} w JOIN ff{k} n ON n.review_id = w.review_id AND n.t = w.t, par{k} p WHERE w.t > 0),
ww{k} AS MATERIALIZED (SELECT * FROM w{k}),
g{k} AS (SELECT f.review_id, f.t, f.o, f.x0 * w.y0 AS g0, f.x1 * w.y1 AS g1, f.x2 * w.y2 AS g2 FROM ff{k} f JOIN ww{k} w USING (review_id, t)),
gs{k} AS (SELECT {gam} FROM g{k}),
xs{k} AS (SELECT {xi} FROM ff{k} f JOIN ff{k} n ON n.review_id = f.review_id AND n.t = f.t + 1
  JOIN ww{k} w ON w.review_id = n.review_id AND w.t = n.t, par{k} p),
par{k + 1} AS MATERIALIZED (SELECT {start}, {trans}, {emit} FROM gs{k}, xs{k})"""


PAR0 = "par0 AS (SELECT " + ", ".join(
    [f"{_lit(hmm.START.start[i])} AS s{i}" for i in range(3)]
    + [f"{_lit(hmm.START.trans[i][j])} AS a{i}{j}" for i in range(3) for j in range(3)]
    + ["[" + ", ".join(_lit(p) for p in hmm.START.emit[i]) + f"] AS b{i}" for i in range(3)]) + ")"

PARAMETERS = "\nUNION ALL ".join(
    [f"SELECT 'start' AS kind, '' AS from_state, '{s}' AS to_state, round(s{i}, 6) AS p FROM par2" for i, s in enumerate(lex.SENTIMENTS)]
    + [f"SELECT 'transition', '{s}', '{t}', round(a{i}{j}, 6) FROM par2" for i, s in enumerate(lex.SENTIMENTS) for j, t in enumerate(lex.SENTIMENTS)]
    + [f"SELECT 'emission', '{s}', '{o}', round(b{i}[{o + 1}], 6) FROM par2" for i, s in enumerate(lex.SENTIMENTS) for o in range(5)])

EM = f"{SYMBOLS}, {OBS}, {PAR0}, {em_ctes(0)}, {em_ctes(1)}"


@query("a15_hmm_fit", f"WITH RECURSIVE {EM} {PARAMETERS}")
def _(d):
    """Two Baum-Welch steps over all documents; SQL repeats them with recursive queries."""
    model = hmm.fit(observed_of(d), max_iter=2, relabel=False)
    return hmm.parameter_table(d.spark, model).withColumn("p", r6("p"))


PASSES = 100  # as hmm.fit
VALUES = ", ".join([f"s{i}" for i in range(3)] + [f"a{i}{j}" for i in range(3) for j in range(3)] + [f"b{i}" for i in range(3)])


def named_ctes() -> str:
    """trained: the one-row model with its states put in the order positive, negative, neutral by their mean symbol."""
    mean = lambda i: "(" + " + ".join(f"{o} * b{i}[{o + 1}]" for o in range(5)) + ")"
    order = "list_transform(list_sort([" + ", ".join(f"{{'m': {mean(i)}, 'i': {i}}}" for i in range(3)) + "]), lambda x: x.i)"
    pick = lambda name: f"[{name}0, {name}1, {name}2]"
    trans = "[" + ", ".join("[" + ", ".join(f"a{i}{j}" for j in range(3)) + "]" for i in range(3)) + "]"
    new = [f"{pick('s')}[q[{i + 1}] + 1] AS s{i}" for i in range(3)]
    new += [f"{trans}[q[{i + 1}] + 1][q[{j + 1}] + 1] AS a{i}{j}" for i in range(3) for j in range(3)]
    new += [f"{pick('b')}[q[{i + 1}] + 1] AS b{i}" for i in range(3)]
    return f"""ordered AS (SELECT *, [o[3], o[1], o[2]] AS q FROM (SELECT *, {order} AS o FROM final_par)),
trained AS MATERIALIZED (SELECT converged, stopped_by, passes, {', '.join(new)} FROM ordered)"""


#: Full training: every pass unrolled, the first gain under the tolerance (0.01) or the last pass ends it.
def trained_ctes(obs: str = OBS) -> str:
    return f"""{SYMBOLS}, {obs}, {PAR0}, {', '.join(em_ctes(k) for k in range(PASSES))},
gains AS (SELECT k, ll - lag(ll) OVER (ORDER BY k) AS gain FROM ({' UNION ALL '.join(f'SELECT {k} AS k, sum(ln(c)) AS ll FROM ff{k}' for k in range(PASSES))})),
ended AS (SELECT coalesce(min(k) FILTER (gain < 0.01), {PASSES - 1}) + 1 AS n, true AS converged,
  CASE WHEN count(*) FILTER (gain < 0.01) > 0 THEN 'tolerance' ELSE 'passes' END AS stopped_by FROM gains),
final_par AS (SELECT converged, stopped_by, n AS passes, {VALUES} FROM ended JOIN ({' UNION ALL '.join(f'SELECT {k} AS n, {VALUES} FROM par{k}' for k in range(1, PASSES + 1))}) USING (n)),
{named_ctes()}"""


TRAINED = trained_ctes()
VITERBI = f"{STATES}, {viterbi_ctes()}"
_hmm_paths: dict = {}


def trained_hmm(d: Tables) -> hmm.HmmModel:
    """The model fitted on all documents, stored once per application and folder and read from its table."""
    key = (d.spark.sparkContext.applicationId, d.folder)
    if key not in _hmm_paths:
        path = scratch_path(d.spark, "hmm")
        models.save_hmm(d.spark, hmm.fit(observed_of(d)), path)
        _hmm_paths[key] = path
    return models.load_hmm(d.spark, _hmm_paths[key])


@query("m09_viterbi", f"WITH RECURSIVE {TRAINED}, {VITERBI} SELECT review_id, array_to_string(states, '|') AS states FROM decoded")
def _(d):
    """Decoded with the trained, stored and loaded model."""
    return sequences_of(d, trained_hmm(d)).select("review_id", joined("sentiment_states").alias("states"))


@query("a15_hmm_converged", f"WITH RECURSIVE {TRAINED} SELECT kind, from_state, to_state, p, converged, stopped_by, passes FROM trained, LATERAL (" + PARAMETERS.replace(" FROM par2", "") + ")")
def _(d):
    """Training until the gain is under the tolerance or PASSES passes are done; ``stopped_by`` says which of the two it was."""
    model = hmm.fit(observed_of(d))
    return hmm.parameter_table(d.spark, model).select("kind", "from_state", "to_state", r6("p").alias("p"), F.lit(model.converged).alias("converged"),
                                                      F.lit(model.stopped_by).alias("stopped_by"), F.lit(model.iterations).alias("passes"))


@query("a31_transition_matrix", f"WITH RECURSIVE {TRAINED} " + "\nUNION ALL ".join(
    f"SELECT '{s}' AS from_state, '{t}' AS to_state, round(a{i}{j}, 6) AS p FROM trained"
    for i, s in enumerate(lex.SENTIMENTS) for j, t in enumerate(lex.SENTIMENTS)))
def _(d):
    return hmm.transition_matrix(d.spark, trained_hmm(d)).withColumn("p", r6("p"))


@query("a33_sequence_score", f"""WITH RECURSIVE {trained_ctes(SPLIT_OBS)}, par{PASSES + 1} AS (SELECT * FROM trained), {forward_ctes(PASSES + 1, 'held_obs')}
SELECT round(sum(ln(c)), 3) AS log_likelihood, count(*) FILTER (WHERE t = 0) AS n_sequences, count(*) AS n_symbols,
  round(exp(-sum(ln(c)) / count(*)), 6) AS perplexity FROM f{PASSES + 1}""")
def _(d):
    """One document in five is scored by the model of the other four."""
    observed = materialize(observed_of(d).withColumn("held", F.substring("review_id", 2, 20).cast("bigint") % 5 == 0), "observed")
    model = hmm.fit(observed.where(~F.col("held")))
    return hmm.score(observed.where("held"), model).withColumns({"log_likelihood": F.round("log_likelihood", 3), "perplexity": r6("perplexity")})
