"""Check queries for dataflow B's text half (S2, S3, S7, P10-P16, J1, F4,
F5, U3) over annotation lines derived from ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeldist import taxonomy as tx
from labeldist.functions import annotation as A
from labeldist.functions import text as TX
from labeldist.operators import standoff as SO
from labeldist.plans import sqlviews as S
from labeldist.plans import views as V
from labeldist.plans.registry import register
from labeldist.session import scratch_path
from labeldist.sources import readers as R
from labeldist.sources import sinks as K


def _keys(doc_id):
    folder = F.lpad((doc_id % 25).cast("string"), 2, "0")
    file = F.concat(F.lit("wsj_"), doc_id.cast("string"))
    return folder.alias("folder"), file.alias("file")


def ann_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Annotation lines ``(doc_id, folder, file, line)``, relation lines only."""
    l = V.v_lines(spark, sf)
    l = l.select("doc_id", *_keys(F.col("doc_id")), "line")
    return l.filter(R.relation_line_filter("line"))


def ann_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Raw documents ``(folder, file, text)`` with trailing white space removed (S3)."""
    d = V.table(spark, sf, "documents").select("doc_id", "text")
    return d.select(*_keys(F.col("doc_id")), R.rstrip(F.col("text")).alias("text"))


def relations(spark: SparkSession, sf: str) -> DataFrame:
    return SO.build_relations(ann_lines(spark, sf).drop("doc_id"), ann_docs(spark, sf))


def _f(i: int) -> str:
    return f"nullif(split_part(line, '|', {i + 1}), '')"


def _split_sql(c: str, p: str) -> str:
    return (f"nullif(split_part({c}, '.', 1), '') AS {p}1, nullif(split_part({c}, '.', 2), '') AS {p}2, "
            f"nullif(regexp_extract({c}, '^[^.]*\\.[^.]*\\.(.*)$', 1), '') AS {p}3, "
            f"coalesce(nullif(regexp_extract({c}, '^[^.]*\\.[^.]*\\.(.*)$', 1), ''), "
            f"nullif(split_part({c}, '.', 2), '')) AS {p}_final")


def _slice_sql(text: str, spans: str) -> str:
    b = f"regexp_extract_all({spans}, '(\\d+)\\.\\.(\\d+)', 1)"
    e = f"regexp_extract_all({spans}, '(\\d+)\\.\\.(\\d+)', 2)"
    return (f"array_to_string(list_transform(range(len({b})), lambda i: substring({text}, "
            f"CAST({b}[i+1] AS INTEGER) + 1, CAST({e}[i+1] AS INTEGER) - CAST({b}[i+1] AS INTEGER))), ' ')")


ANN_SQL = "WITH " + S.V_LINES + f""",
ann AS (SELECT doc_id, lpad(CAST(doc_id % 25 AS VARCHAR), 2, '0') AS folder,
               concat('wsj_', CAST(doc_id AS VARCHAR)) AS file, line
        FROM v_lines WHERE starts_with(line, 'Implicit') OR starts_with(line, 'Explicit')),
docs AS (SELECT lpad(CAST(doc_id % 25 AS VARCHAR), 2, '0') AS folder, concat('wsj_', CAST(doc_id AS VARCHAR)) AS file,
                regexp_replace(text, '[{TX.WHITESPACE_CLASS}]+$', '') AS text FROM documents),
f AS (SELECT doc_id, folder, file, line, {_f(0)} AS relation, {_f(7)} AS connective, {_f(8)} AS sense,
             {_f(14)} AS arg1_spans, {_f(20)} AS arg2_spans,
             CASE WHEN {_f(0)} = 'Implicit' THEN {_f(10)} END AS multi_connective,
             CASE WHEN {_f(0)} = 'Implicit' THEN {_f(11)} END AS multi_sense
      FROM ann),
s AS (SELECT *, {_split_sql('sense', 'sense')}, {_split_sql('multi_sense', 'multi_sense')} FROM f),
rel AS (SELECT s.*, {_slice_sql('d.text', 'arg1_spans')} AS arg1, {_slice_sql('d.text', 'arg2_spans')} AS arg2,
               CAST(regexp_extract(arg1_spans, '(\\d+)\\.\\.', 1) AS INTEGER) AS begin
        FROM s JOIN docs d ON d.folder = s.folder AND d.file = s.file)
"""


@register("annotation_line_filter", ANN_SQL + "SELECT doc_id, relation FROM f")
def annotation_line_filter(spark, sf):
    """Relation lines kept, relation type read from field 0."""
    return ann_lines(spark, sf).select("doc_id", A.field("line", A.FIELD_RELATION).alias("relation"))


@register("pipe_fields", ANN_SQL + "SELECT doc_id, relation, connective, sense, arg1_spans, arg2_spans FROM f")
def pipe_fields(spark, sf):
    """P10: positional fields."""
    return ann_lines(spark, sf).select("doc_id", A.parse_annotation("line").alias("a")).select("doc_id", "a.*")


@register("optional_second_sense", ANN_SQL + "SELECT doc_id, multi_connective, multi_sense FROM f")
def optional_second_sense(spark, sf):
    """Second connective / sense on implicit lines only."""
    return ann_lines(spark, sf).select("doc_id", A.parse_second_sense("line").alias("m")).select("doc_id", "m.*")


@register("split_sense_path", ANN_SQL + """
SELECT doc_id, sense1, sense2, sense3, sense_final, multi_sense1, multi_sense2, multi_sense3, multi_sense_final FROM s""")
def split_sense_path(spark, sf):
    """Both sense paths split into levels."""
    p = SO.parse_lines(ann_lines(spark, sf), keep=["doc_id"])
    return p.select("doc_id", "sense1", "sense2", "sense3", "sense_final",
                    "multi_sense1", "multi_sense2", "multi_sense3", "multi_sense_final")


@register("parse_spans", ANN_SQL + """,
sp AS (SELECT doc_id, 1 AS arg, arg1_spans AS spans FROM f UNION ALL SELECT doc_id, 2, arg2_spans FROM f),
bb AS (SELECT doc_id, arg, regexp_extract_all(spans, '(\\d+)\\.\\.(\\d+)', 1) AS b,
              regexp_extract_all(spans, '(\\d+)\\.\\.(\\d+)', 2) AS e FROM sp)
SELECT doc_id, CAST(arg AS INTEGER) AS arg, CAST(generate_subscripts(b, 1) - 1 AS INTEGER) AS pos,
       CAST(unnest(b) AS INTEGER) AS b, CAST(unnest(e) AS INTEGER) AS e FROM bb""")
def parse_spans_q(spark, sf):
    """Span lists -> (begin, end) pairs."""
    p = ann_lines(spark, sf).select("doc_id", A.parse_annotation("line").alias("a"))
    sp = p.select("doc_id", F.inline(F.array(
        F.struct(F.lit(1).alias("arg"), A.parse_spans("a.arg1_spans").alias("spans")),
        F.struct(F.lit(2).alias("arg"), A.parse_spans("a.arg2_spans").alias("spans")))))
    x = sp.select("doc_id", "arg", F.posexplode("spans").alias("pos", "s"))
    return x.select("doc_id", "arg", "pos", F.col("s.b").alias("b"), F.col("s.e").alias("e"))


@register("slice_spans", ANN_SQL + f"""
SELECT f.doc_id, {_slice_sql('d.text', 'f.arg1_spans')} AS arg1, {_slice_sql('d.text', 'f.arg2_spans')} AS arg2
FROM f JOIN docs d ON d.folder = f.folder AND d.file = f.file""")
def slice_spans_q(spark, sf):
    """P15 without a join: the annotation line is derived in the document's row."""
    d = V.v_lines(spark, sf).filter(R.relation_line_filter("line")).join(V.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    d = d.select("doc_id", R.rstrip(F.col("text")).alias("t"), A.parse_annotation("line").alias("a"))
    return d.select("doc_id", A.slice_spans("t", A.parse_spans("a.arg1_spans")).alias("arg1"),
                    A.slice_spans("t", A.parse_spans("a.arg2_spans")).alias("arg2"))


@register("standoff_join_slice", ANN_SQL + "SELECT folder, file, arg1, arg2, arg1 || ' ' || arg2 AS arg1_arg2 FROM rel")
def standoff_join_slice(spark, sf):
    """J1 + P15: annotations joined with their documents, spans cut out."""
    return relations(spark, sf).select("folder", "file", "arg1", "arg2", "arg1_arg2")


def _onehot_sql() -> str:
    cols = [f"CASE WHEN sense2 = '{v}' THEN 1.0E0 ELSE 0.0E0 END AS \"{v.lower()}\"" for v in tx.STANDOFF_L2]
    cols += [f"CASE WHEN sense1 = '{v}' THEN 1.0E0 ELSE 0.0E0 END AS \"{v.lower()}\"" for v in tx.STANDOFF_L1]
    return ", ".join(cols)


@register("one_hot_senses", ANN_SQL + f"""
SELECT folder, file, sense2 AS majority_level_2, sense1 AS majority_level_1, {_onehot_sql()} FROM rel""")
def one_hot_senses(spark, sf):
    """One-hot level-2 (21) and level-1 (4) senses, from the lines alone."""
    r = SO.sense_columns(SO.parse_lines(ann_lines(spark, sf)))
    return r.select("folder", "file", "majority_level_2", "majority_level_1",
                    *[v.lower() for v in tx.STANDOFF_L2 + tx.STANDOFF_L1])


@register("single_sense_only", ANN_SQL + "SELECT file, relation, sense1 FROM rel WHERE multi_sense1 IS NULL")
def single_sense_only(spark, sf):
    """relations with one sense."""
    return SO.single_sense(relations(spark, sf)).select("file", "relation", "sense1")


@register("relation_filter", ANN_SQL + "SELECT file, sense1 FROM rel WHERE relation = 'Explicit'")
def relation_filter(spark, sf):
    """one relation type."""
    return SO.by_relation(relations(spark, sf), "Explicit").select("file", "sense1")


@register("relations_sorted", ANN_SQL + "SELECT folder, file, begin, relation, sense_final FROM rel")
def relations_sorted(spark, sf):
    """Relation table written sorted by file, read back."""
    path = scratch_path(spark, "relations")
    K.write_relations(relations(spark, sf), path)
    return spark.read.parquet(path).select("folder", "file", "begin", "relation", "sense_final")


# --- sources: rows written as files, read by the readers ------------------------

def _write_files(df: DataFrame, root: str) -> None:
    """One file per row of ``(folder, file, content)``, written by the tasks to a folder that all can reach."""
    def run(batches):
        import pyarrow.fs
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        for pdf in batches:
            for folder, file, content in zip(pdf["folder"], pdf["file"], pdf["content"], strict=True):
                fs.create_dir(f"{base}/{folder}", recursive=True)
                with fs.open_output_stream(f"{base}/{folder}/{file}") as out:
                    out.write(content)
            yield pdf[["file"]]

    df.mapInPandas(run, "file string").write.format("noop").mode("overwrite").save()


def _file_name(doc_id):
    """Names with a blank, a percent sign, a plus and an accent."""
    return F.concat(F.lit("é 5%20+"), F.lpad((doc_id % 25).cast("string"), 2, "0")), F.concat(F.lit("wsj %_"), doc_id.cast("string"), F.lit("ü"))


def _root(spark: SparkSession, name: str) -> str:
    path = scratch_path(spark, name)
    return path if "://" in path or path.startswith("file:") else "file://" + path


_NAMES_SQL = "'é 5%20+' || lpad(CAST(doc_id % 25 AS VARCHAR), 2, '0') AS folder, 'wsj %_' || doc_id || 'ü' AS file"


@register("read_raw_files", f"""
SELECT {_NAMES_SQL}, md5(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[{TX.WHITESPACE_CLASS}]+$', '')) AS text_md5
FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^\\x00-\\xFF]')""")
def read_raw_files(spark, sf):
    """Documents as files in ISO-8859-1 (those that it can write), with line ends of two kinds and names that file
    metadata encodes, read again."""
    d = V.table(spark, sf, "documents").filter(F.col("text").isNotNull() & ~F.col("text").rlike(r"[^\x00-\xFF]"))
    folder, file = _file_name(F.col("doc_id"))
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    root = _root(spark, "raw")
    _write_files(d.select(folder.alias("folder"), file.alias("file"), F.encode(text, "ISO-8859-1").alias("content")), root)
    return R.read_raw_docs(spark, root).select("folder", "file", F.md5("text").alias("text_md5"))


@register("read_annotation_files", ANN_SQL + f"""
SELECT {_NAMES_SQL}, line FROM ann""")
def read_annotation_files(spark, sf):
    """Annotation lines as a tree of files (other lines among them), read again with their places."""
    folder, file = _file_name(F.col("doc_id"))
    lines = V.v_lines(spark, sf).groupBy("doc_id").agg(F.array_join(F.collect_list("line"), " \n").alias("text"))
    root = _root(spark, "gold")
    _write_files(lines.select(folder.alias("folder"), file.alias("file"), F.encode("text", "UTF-8").alias("content")), root)
    return R.read_annotations(spark, root).select("folder", "file", "line")


@register("read_prompt_files", """
SELECT lang, 'Texts in ' || lang || ': ' || count(*) || chr(10) || 'Answer "yes" or 100 %.' AS prompt, 0 AS idx, CAST(NULL AS VARCHAR) AS answer
FROM documents WHERE lang IS NOT NULL GROUP BY lang
UNION ALL SELECT lang, md5(text), CAST(doc_id % 5 AS INTEGER), CAST(doc_id AS VARCHAR) FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL""")
def read_prompt_files(spark, sf):
    """Prompt files (one per language) and exemplars (JSON lines), read again."""
    d = V.table(spark, sf, "documents").filter(F.col("lang").isNotNull())
    prompts = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("").alias("folder"), F.concat(F.lit("main prompt 5%_"), F.col("lang"), F.lit(".txt")).alias("file"),
        F.encode(F.concat(F.lit("Texts in "), "lang", F.lit(": "), "n", F.lit('\nAnswer "yes" or 100 %.')), "UTF-8").alias("content"))
    root = _root(spark, "prompts")
    _write_files(prompts, root)
    path = scratch_path(spark, "exemplars")
    d.filter(F.col("text").isNotNull()).select("lang", (F.col("doc_id") % 5).cast("int").alias("idx"), F.col("text").alias("question"),
                                               F.col("doc_id").cast("string").alias("answer")).write.json(path)
    read = R.read_prompts(spark, root).select("lang", "prompt", F.lit(0).alias("idx"), F.lit(None).cast("string").alias("answer"))
    return read.union(R.read_exemplars(spark, path).select("lang", F.md5("question"), "idx", "answer"))


@register("relation_cluster_eval", ANN_SQL + """
SELECT sense1, count(*) AS n, 4 AS n_clusters, true AS counted, true AS again FROM rel
WHERE relation = 'Implicit' AND multi_sense1 IS NULL AND sense1 IS NOT NULL AND arg1 || ' ' || arg2 IS NOT NULL GROUP BY sense1""")
def relation_cluster_eval(spark, sf):
    """Dataflow B end to end: relations (annotation lines x documents) ->
    single-sense, one relation type -> TF-IDF embedding of the argument
    pair -> k-means with 4 clusters -> optimal mapping -> accuracy per
    level-1 sense.  Per sense: its rows, the number of clusters, whether the accuracy is the share of rows whose cluster
    is mapped to the sense, and whether a second fit gives the same one."""
    from labeldist.operators import clustering as CL
    from labeldist.operators import features as FE
    rel = SO.by_relation(SO.single_sense(relations(spark, sf)), "Implicit")
    rel = rel.filter(F.col("arg1_arg2").isNotNull())
    path = scratch_path(spark, "embedded")
    FE.as_features(FE.embed(rel.select("file", "sense1", "arg1_arg2"), "arg1_arg2", num_features=1 << 10)).select(
        "file", "sense1", "features").write.parquet(path)
    emb = spark.read.parquet(path)

    def accuracy():
        c = CL.cluster(emb, "kmeans", k=4).select("file", "sense1", "cluster")
        mapped, _, per = CL.evaluate_clusters(c, "cluster", "sense1")
        return mapped, per
    mapped, per = accuracy()
    own = mapped.groupBy("sense1").agg(F.count(F.lit(1)).alias("n"), (100 * F.avg(F.coalesce(
        F.col("predicted_sense") == F.col("sense1"), F.lit(False)).cast("int"))).alias("share"))
    size = mapped.agg(F.count_distinct("cluster").cast("int").alias("n_clusters")).withColumn("sense1", F.explode(
        F.array(*[F.lit(x) for x in tx.STANDOFF_L1])))
    again = accuracy()[1].select("sense1", F.col("accuracy").alias("second"))
    return own.join(per, "sense1").join(again, "sense1").join(size, "sense1").select(
        "sense1", "n", "n_clusters", (F.abs(F.col("accuracy") - F.col("share")) < 1e-4).alias("counted"),
        (F.abs(F.col("accuracy") - F.col("second")) < 1e-6).alias("again"))
