"""Pooling, cross-validation by groups, linear probes, banks of families, nested reports, numbered lines, resumed runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranking import portable_hash
from ..operators import metrics, nested, probes, resample, sampling, similarity
from ..shared import folder, materialize
from ..sources import readers
from ..streaming import resume
from ..views import HEAD, HYBRID_SQL, RUNS_SQL, label_name, runs, table
from .evaluation import ROUNDS, SEED, tree_sql
from .registry import hash_sql, registry

QUERIES, ORACLE_SQL, query = registry()

SPECS = {"all": ("all", "mean"), "audio_std": ("audio", "std"), "audio_stats": ("audio", "stats"), "audio_attn": ("audio", "attn")}


@query("""WITH x AS (SELECT vec_id, p // 32 AS layer, (p % 32) // 4 AS f, p % 4 AS k, v, vec_id % 5 = 0 OR ((p % 32) // 4) % 2 = 0 AS told FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)),
m AS (SELECT vec_id, layer, k, avg(v) AS every, avg(v) FILTER (WHERE told) AS mean FROM x GROUP BY ALL),
d AS (SELECT vec_id, layer, k, every, mean, sqrt(avg((v - mean) * (v - mean)) + 1e-6) AS std FROM x JOIN m USING (vec_id, layer, k) WHERE told GROUP BY ALL),
s AS (SELECT vec_id, layer, f, exp(sum(v * mean) / 2) AS e FROM x JOIN m USING (vec_id, layer, k) WHERE told GROUP BY ALL),
w AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id, layer) AS w FROM s),
a AS (SELECT vec_id, layer, k, sum(v * w) AS amean FROM x JOIN w USING (vec_id, layer, f) GROUP BY ALL),
b AS (SELECT vec_id, layer, k, amean, sqrt(sum((v - amean) * (v - amean) * w) + 1e-6) AS astd FROM x JOIN w USING (vec_id, layer, f) JOIN a USING (vec_id, layer, k) GROUP BY ALL),
l AS (SELECT vec_id, layer, 'all' AS spec, k AS pos, every AS v FROM d UNION ALL SELECT vec_id, layer, 'audio_std', k, std FROM d UNION ALL SELECT vec_id, layer, 'audio_stats', k, mean FROM d UNION ALL SELECT vec_id, layer, 'audio_stats', k + 4, std FROM d
   UNION ALL SELECT vec_id, layer, 'audio_attn', k, amean FROM b UNION ALL SELECT vec_id, layer, 'audio_attn', k + 4, astd FROM b)
SELECT vec_id, CAST(layer AS INT) AS layer, spec, CAST(pos AS INT) AS pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id, layer, spec)), 6) AS value FROM l""")
def pooled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers of eight frames of four numbers, pooled four ways; a fifth of the rows has no frame of its own kind."""
    e = table(spark, sf_dir, "embeddings")
    layers = F.explode(F.array(F.lit(0), F.lit(1))).alias("layer")
    frames = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", F.col("layer") * 32 + i * 4 + 1, 4))
    rows = e.select("vec_id", "embedding", layers).select("vec_id", "layer", frames.alias("frames"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i % 2 == 0) & (F.col("vec_id") % 5 != 0)).alias("mask"))
    out = similarity.pooled(rows, ["vec_id", "layer"], "frames", "mask", SPECS)
    long = out.select("vec_id", "layer", F.inline(F.array(*[F.struct(F.lit(s).alias("spec"), F.col(s).alias("v")) for s in SPECS])))
    return long.select("vec_id", "layer", "spec", F.posexplode("v").alias("pos", "value")).withColumn("value", F.round("value", 6))


FOLDS = 4
CV_SQL = RUNS_SQL + f""", g AS (SELECT candidate, pos, sample_id, hit, CAST(floor(sqrt(vec_id)) AS BIGINT) AS speaker FROM runs),
sz AS (SELECT speaker, row_number() OVER (ORDER BY count(*) DESC, speaker) - 1 AS r FROM g WHERE candidate = 'asr' GROUP BY speaker),
fo AS (SELECT speaker, CASE WHEN (r // {FOLDS}) % 2 = 0 THEN r % {FOLDS} ELSE {FOLDS - 1} - r % {FOLDS} END AS fold FROM sz),
gf AS (SELECT g.*, fold FROM g JOIN fo USING (speaker)),
tb AS (SELECT fold, candidate, pos, count(*) AS n, count(*) FILTER (hit) AS h FROM gf GROUP BY ALL),
tw AS (SELECT *, round((sum(h) OVER w - h) / CAST(sum(n) OVER w - n AS DOUBLE), 6) AS dev, round(h / CAST(n AS DOUBLE), 6) AS acc FROM tb WINDOW w AS (PARTITION BY candidate)),
pk AS (SELECT * FROM tw QUALIFY row_number() OVER (PARTITION BY fold ORDER BY dev DESC, pos) = 1)"""


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates as options, in four folds of whole speakers, whose sizes grow with their number."""
    r = runs(spark, sf_dir).withColumn("speaker", F.floor(F.sqrt("vec_id")))
    folds = sampling.balanced_folds(r.where("candidate = 'asr'").select("sample_id", "speaker"), "speaker", FOLDS).select("sample_id", "fold")
    return materialize(r.select("candidate", "pos", "sample_id", "speaker", F.col("hit").alias("correct")).join(folds, "sample_id"), "folded")


@query(f"""WITH {CV_SQL} SELECT CAST(pk.fold AS INT) AS fold, pk.candidate, pk.dev AS dev_accuracy, pk.n, pk.acc AS accuracy, b.acc AS baseline_accuracy, round(pk.acc - b.acc, 6) AS delta, (SELECT count(*) FROM fo WHERE fo.fold = pk.fold) AS speakers
FROM pk JOIN tw b ON b.fold = pk.fold AND b.candidate = 'asr'""")
def grouped_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The option of each fold is chosen on the others, and held to this one."""
    rows = folded(spark, sf_dir)
    return probes.nested_choice(rows, "candidate", "pos", "asr").join(rows.groupBy("fold").agg(F.count_distinct("speaker").alias("speakers")), "fold")


@query(f"""WITH {CV_SQL}, sel AS (SELECT gf.speaker, CAST(gf.hit AS INT) - CAST(b.hit AS INT) AS d FROM gf JOIN pk ON gf.fold = pk.fold AND gf.candidate = pk.candidate JOIN gf b ON b.sample_id = gf.sample_id AND b.candidate = 'asr'),
gs AS (SELECT speaker, count(*) AS n, sum(d) AS s, row_number() OVER (ORDER BY speaker) - 1 AS j FROM sel GROUP BY speaker), ka AS (SELECT 'all' AS one, j, 1 AS w FROM gs),
{tree_sql("kt", "ka", "one", 8, ROUNDS, f"'{SEED}'")},
b AS (SELECT round, sum(x * s) / CAST(sum(x * n) AS DOUBLE) AS value FROM kt JOIN gs USING (j) GROUP BY round)
SELECT CAST((SELECT sum(n) FROM gs) AS BIGINT) AS n, (SELECT count(*) FROM gs) AS groups, round((SELECT sum(s) / CAST(sum(n) AS DOUBLE) FROM gs), 6) AS delta, round(quantile_cont(value, 0.025), 6) AS ci_low, round(quantile_cont(value, 0.975), 6) AS ci_high FROM b""")
def grouped_cv_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All folds' gains over the baseline, pooled, with whole speakers drawn."""
    rows = folded(spark, sf_dir)
    picked = F.broadcast(probes.nested_choice(rows, "candidate", "pos", "asr").select("fold", "candidate"))  # a row a fold
    base = rows.where("candidate = 'asr'").select("sample_id", F.col("correct").alias("base"))
    gains = rows.join(picked, ["fold", "candidate"]).join(base, "sample_id").withColumn("d", F.col("correct").cast("double") - F.col("base").cast("double"))
    return resample.cluster_bootstrap(gains, "speaker", "d", ROUNDS, SEED)


@query()
def probe_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by a ridge classifier over whole vectors, in four folds of whole speakers."""
    e = table(spark, sf_dir, "embeddings").withColumn("speaker", F.floor(F.sqrt("vec_id")))
    return probes.linear_probe(sampling.balanced_folds(e, "speaker", FOLDS), "vec_id", "embedding", "label", "fold")


ARMS = {"head": HEAD, "full": slice(None), "tail": slice(48, 64)}


@query(f"""WITH {HYBRID_SQL}, ar AS (SELECT * FROM (VALUES ('head', 1, 16), ('full', 1, 64), ('tail', 49, 64)) AS v(arm, a, b)),
fd AS (SELECT x.vec_id, x.label, arm, cand, round(sum(x.v * bank.m) / (sqrt(sum(x.v * x.v)) * sqrt(sum(bank.m * bank.m))), 6) AS s FROM x JOIN bank ON x.p = bank.p AND x.label % 4 = bank.cand % 4 JOIN ar ON x.p BETWEEN a AND b GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY vec_id, arm ORDER BY s DESC, cand) AS rank FROM fd)
SELECT (['alarm', 'email', 'music', 'play'])[label % 4 + 1] AS family, arm, count(*) AS n, round(avg(CAST(rank = 1 AS INT)), 6) AS acc_at_1, round(avg(CAST(rank <= 3 AS INT)), 6) AS recall_at_3, round(avg(1e0 / rank), 6) AS mrr
FROM fr WHERE cand = label GROUP BY 1, 2""")
def family_arm_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each family's rows against its own labels, by three arms, in one pass."""
    family = lambda c: F.split_part(label_name(c), F.lit("_"), F.lit(1))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    banks = similarity.bank(e).withColumn("family", family(F.col("label")))
    ranks = similarity.group_ranks(e.withColumn("family", family(F.col("label"))), banks, ["vec_id"], "family", "label", ARMS)
    return ranks.groupBy("family", "arm").agg(F.count("rank").alias("n"), metrics.rate(F.col("rank") == 1).alias("acc_at_1"), metrics.rate(F.col("rank") <= 3).alias("recall_at_3"), metrics.mean(1.0 / F.col("rank")).alias("mrr"))


@query(f"WITH {HYBRID_SQL} SELECT vec_id, cand, s_omni, r_omni, s_asr, r_asr, r_rrf FROM lr")
def bank_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows against a bank that is cut into blocks of four labels."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    return similarity.rank_views(e, similarity.bank(e), ["vec_id"], {"asr": HEAD, "omni": slice(None)}, most_labels=4).select("vec_id", "cand", "s_omni", "r_omni", "s_asr", "r_asr", "r_rrf")


def report(spark: SparkSession, sf_dir: str, changed: bool) -> DataFrame:
    """(source, doc): a nested report of each source's documents; a second version differs by the source's first letter."""
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean"), F.slice(F.array_sort(F.collect_set("lang")), 1, 3).alias("langs"), F.min("doc_id").alias("first"))
    k = F.pmod(F.ascii("source"), F.lit(4))
    mean, langs, name = F.col("mean"), F.col("langs"), F.lit("own")
    if changed:
        mean = F.when(k == 0, mean + 1e-9).when(k == 1, mean + 0.5).otherwise(mean)
        langs = F.when(k == 2, F.slice("langs", 1, 2)).otherwise(langs)
        name = F.when(k == 3, "other").otherwise("own")
    doc = F.struct(F.struct("n", mean.alias("mean"), F.struct(langs.alias("langs"), F.array(F.struct("first")).alias("rows")).alias("parts")).alias("metrics"), name.alias("kind"), *([F.lit(True).alias("more")] if changed else []))
    return d.select("source", F.parse_json(F.to_json(doc)).alias("doc"))


@query("""WITH d AS (SELECT source, ascii(source) % 4 AS k, count(*) AS n, avg(n_chars) AS mean, list_sort(list(DISTINCT lang) FILTER (lang IS NOT NULL))[1:3] AS langs, min(doc_id) AS first FROM documents GROUP BY source),
l AS (SELECT source, k, unnest(langs) AS lang, generate_subscripts(langs, 1) - 1 AS i FROM d)
SELECT source, '$.metrics.n' AS path, 'equal' AS status FROM d UNION ALL SELECT source, '$.metrics.mean', CASE k WHEN 0 THEN 'close' WHEN 1 THEN 'differs' ELSE 'equal' END FROM d
UNION ALL SELECT source, '$.metrics.parts.langs[' || i || ']', CASE WHEN k = 2 AND i = 2 THEN 'missing' ELSE 'equal' END FROM l UNION ALL SELECT source, '$.metrics.parts.rows[0].first', 'equal' FROM d
UNION ALL SELECT source, '$.kind', CASE k WHEN 3 THEN 'differs' ELSE 'equal' END FROM d UNION ALL SELECT source, '$.more', 'extra' FROM d""")
def nested_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of nested reports, leaf by leaf."""
    return nested.compare(report(spark, sf_dir, True), report(spark, sf_dir, False), ["source"], "doc").select("source", "path", "status")


#: Files that lines are written to at least, and bytes of text in one, which one task sorts.
LEAST_FILES, FILE_BYTES = 3, 1 << 27


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS line_no FROM documents")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines, in order, to several files, and read again with the numbers of their lines; those of
    earlier files come before."""
    path = folder(spark, "lines")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = d.repartitionByRange(max(LEAST_FILES, -(-size // FILE_BYTES)), "doc_id").sortWithinPartitions("doc_id")
    rows.withColumn("text", F.translate("text", "\r", " ")).write.json(path)
    number = readers.numbered_lines(spark, path).select("file", "line_no", F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"))
    lines = materialize(number, "numbered")
    files = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))  # a row a file
    before = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return lines.join(F.broadcast(before), "file").select("doc_id", (F.col("before") + F.col("line_no")).alias("line_no"))


class Interrupted(Exception):
    pass


@query(f"""SELECT doc_id, length(text) AS answer, CASE WHEN {hash_sql("'first'", "CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN 1 ELSE 0 END AS failures, true AS complete FROM documents WHERE text IS NOT NULL""")
def resumed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation that breaks off after three slices, goes on, and is run once more for the rows that had an error: a fifth
    of them fail at their first try."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    output, calls = folder(spark, "answers"), [0]

    def evaluate(left: DataFrame, stop: int | None, first: bool) -> DataFrame:
        if calls[0] == stop:
            raise Interrupted
        calls[0] += 1
        bad = F.lit(first) & (portable_hash("first", F.col("doc_id").cast("string")) % 5 == 0)
        return left.select("doc_id", F.length("text").cast("long").alias("answer"), F.when(bad, "timeout").alias("error"))

    run = lambda stop, first: resume.resumed(rows, lambda left: evaluate(left, stop, first), output, {"model": "length", "seed": 1}, "doc_id", 6)
    try:
        run(3, True)
    except Interrupted:
        run(None, True)
    done = run(None, False)
    tries = resume.written(spark, output).groupBy("doc_id").agg(F.sign(F.count("error")).cast("int").alias("failures"))
    return done.join(tries, "doc_id").select("doc_id", "answer", "failures", "complete")
