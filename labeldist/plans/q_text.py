"""Check queries for dataflow A: sources, text functions, filters, reshaping
(S1, S4-S6, P1-P3, P17-P19, F1-F3, U1-U2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labeldist import taxonomy as tx
from labeldist.functions import distributions as D
from labeldist.functions import text as TX
from labeldist.operators import corpus as C
from labeldist.operators import metrics as M
from labeldist.plans import sqlviews as S
from labeldist.plans import views as V
from labeldist.plans.registry import register
from labeldist.session import scratch_path
from labeldist.sources import readers as R
from labeldist.sources import sinks as K

WITH_ITEMS = "WITH " + S.V_ITEMS + "\n"


@register("scan_items_projection", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source FROM documents""")
def scan_items_projection(spark, sf):
    """S1 stand-in: a named column subset, every value a string."""
    d = R.read_table(spark, f"{sf}/documents.parquet", ["doc_id", "lang", "source"])
    return d.select(*[F.col(c).cast("string").alias(c) for c in d.columns])


@register("scan_pruned_columns", """
SELECT doc_id, n_chars FROM documents WHERE lang = 'fr'""")
def scan_pruned_columns(spark, sf):
    """Two columns with a filter; both reach the Parquet scan."""
    d = R.read_table(spark, f"{sf}/documents.parquet", ["doc_id", "n_chars", "lang"])
    return d.filter(F.col("lang") == "fr").select("doc_id", "n_chars")


@register("vector_literal_roundtrip", """
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, true AS exact,
       round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total
FROM embeddings""")
def vector_literal_roundtrip(spark, sf):
    """Vectors written as list literals and parsed back are unchanged."""
    e = V.table(spark, sf, "embeddings")
    lit = "concat('[', array_join(transform(embedding, x -> CAST(x AS STRING)), ', '), ']')"
    p = e.select("vec_id", "embedding", D.parse_vector(lit).alias("v"))
    back = F.transform("v", lambda x: x.cast("float"))
    return p.select(
        "vec_id", F.size("v").cast("int").alias("dim"),
        (back == F.col("embedding")).alias("exact"),
        F.round(F.aggregate(back, F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@register("corpus_partition_counts", WITH_ITEMS + """
SELECT inst_lang, split, count(*) AS n FROM v_items GROUP BY ALL""")
def corpus_partition_counts(spark, sf):
    """One partitioned write, read back with partition discovery."""
    path = scratch_path(spark, "corpus")
    K.write_corpus(V.v_items(spark, sf), path)
    back = spark.read.parquet(path)
    return back.groupBy("inst_lang", "split").agg(F.count(F.lit(1)).alias("n"))


@register("conform_columns", """
SELECT doc_id AS itemid, lang AS orig_lang, source AS corpus, n_chars AS length FROM documents""")
def conform_columns(spark, sf):
    """Select, reorder, rename."""
    return C.conform(V.table(spark, sf, "documents"),
                     {"doc_id": "itemid", "lang": "orig_lang", "source": "corpus", "n_chars": "length"})


@register("strip_markup", """
SELECT page_id, md5(regexp_replace(url, '<a[^>]*>', '', 'g')) AS url_md5,
       md5(regexp_replace(html, '<a[^>]*>', '', 'g')) AS html_md5
FROM pages""")
def strip_markup_q(spark, sf):
    """Remove ``<a ...>`` openings from every string column."""
    p = C.strip_markup_all(V.table(spark, sf, "pages"), "a")
    return p.select("page_id", F.md5("url").alias("url_md5"), F.md5("html").alias("html_md5"))


@register("pair_text", WITH_ITEMS + """
SELECT itemid, arg1 || ' ' || arg2 AS arg1_arg2 FROM v_items""")
def pair_text_q(spark, sf):
    """NULL-propagating pair text."""
    return V.v_items(spark, sf).select("itemid", TX.pair_text("arg1", "arg2").alias("arg1_arg2"))


@register("strip_suffix", WITH_ITEMS + """
SELECT itemid, regexp_replace(concat('sense_', inst_lang), '_(en|de|fr|cs)$', '') AS label FROM v_items""")
def strip_suffix_q(spark, sf):
    """Language suffix removed at the end of labels (``es`` is kept)."""
    i = V.v_items(spark, sf)
    return i.select("itemid", TX.strip_suffix(F.concat(F.lit("sense_"), F.col("inst_lang"))).alias("label"))


@register("short_name", """
SELECT page_id, regexp_extract(url, '[^/]+$') AS name FROM pages""")
def short_name_q(spark, sf):
    """Last path segment."""
    return V.table(spark, sf, "pages").select("page_id", TX.short_name("url").alias("name"))


@register("unpivot_langs", "WITH " + S.V_WIDE + "\n" + "\nUNION ALL ".join(
    f"SELECT itemid, '{l}' AS inst_lang, md5(text_{l}) AS text_md5 FROM v_wide WHERE text_{l} IS NOT NULL"
    for l in ("en", "de", "fr", "es")))
def unpivot_langs_q(spark, sf):
    """One row per item and language from a wide table, one pass."""
    w = V.v_wide(spark, sf)
    u = C.unpivot_langs(w, ["en", "de", "fr", "es"], {"text": "text_{l}"}, keep=["itemid"])
    return u.filter(F.col("text").isNotNull()).select("itemid", "inst_lang", F.md5("text").alias("text_md5"))


@register("union_langs", """
SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de', 'fr', 'es')""")
def union_langs_q(spark, sf):
    """Separately loaded language tables stacked by column name."""
    d = V.table(spark, sf, "documents").select("doc_id", "lang")
    return C.union_langs([d.filter(F.col("lang") == l) for l in ("en", "de", "fr", "es")])


@register("split_counts", WITH_ITEMS + """
SELECT split, count(*) AS n FROM v_items GROUP BY split""")
def split_counts(spark, sf):
    """rows per split (split filter, then one aggregation)."""
    i = C.splits(V.v_items(spark, sf), ["train", "dev", "test"])
    return i.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("require_label_langs", WITH_ITEMS + """,
lab AS (SELECT i.itemid, i.inst_lang,
               CASE WHEN l.quality = 1 THEN 'expansion' WHEN l.quality = 0 THEN 'comparison' END AS majority_level_1
        FROM v_items i LEFT JOIN labels l ON l.doc_id = i.itemid)
SELECT * FROM lab WHERE inst_lang = 'en' OR majority_level_1 IS NOT NULL""")
def require_label_langs(spark, sf):
    """unlabelled instances dropped except for English."""
    i = V.v_items(spark, sf).select("itemid", "inst_lang")
    lab = V.table(spark, sf, "labels").select(F.col("doc_id").alias("itemid"), "quality")
    j = i.join(lab, "itemid", "left").select(
        "itemid", "inst_lang",
        F.when(F.col("quality") == 1, "expansion").when(F.col("quality") == 0, "comparison")
         .alias("majority_level_1"))
    return C.require_label(j)


_WS_SQL = TX.WHITESPACE_CLASS


@register("drop_blank_text", f"""
SELECT itemid, pos FROM (
  SELECT doc_id AS itemid, CAST(unnest(range(0, len(ls))) AS INTEGER) AS pos, unnest(ls) AS t
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
WHERE regexp_matches(t, '[^{_WS_SQL}]')""")
def drop_blank_text(spark, sf):
    """lines (of all texts) that are empty or white space only are dropped."""
    d = V.table(spark, sf, "documents").select(
        F.col("doc_id").alias("itemid"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "t"))
    return C.drop_blank(d, "t").select("itemid", "pos")


# ---------------------------------------------------------- dataflow A end to end

CORPUS_TEST_LANGS = ["en", "de", "fr", "es"]


def _dist_literal_sql(doc: str, short: bool) -> str:
    """A single-quoted distribution literal over the source keys (+ excluded
    label) with values 0.d derived from a document id (SQL text, both engines)."""
    keys = tx.L3_SOURCE_KEYS[:5] if short else tx.L3_SOURCE_KEYS
    parts = []
    for i, k in enumerate(keys):
        parts.append(f"'\\'{k}\\': 0.' || CAST(({doc} * {i + 3}) % 10 AS STRING)")
    parts.append(f"'\\'{tx.EXCLUDED_LABEL}\\': 0.' || CAST({doc} % 10 AS STRING)")
    return "'{' || " + " || ', ' || ".join(parts) + " || '}'"


def items_table(spark, sf):
    """An all-string item table in the wide corpus layout, built from
    ``documents``: every document is an item in its language; the split
    follows the item number; the text's halves are the arguments;
    distribution literals derive from the ids (every sixth lists only five
    senses, i.e. a partial row)."""
    d = V.table(spark, sf, "documents")
    g = d.select(F.col("doc_id").alias("item"),
                 *[F.when(F.col("lang") == l, F.col("text")).alias(f"text_{l}") for l in CORPUS_TEST_LANGS],
                 *[F.when(F.col("lang") == l, F.col("doc_id")).alias(f"doc_{l}") for l in CORPUS_TEST_LANGS])
    cols = [F.expr("CASE WHEN (item DIV 4) % 10 < 7 THEN 'train' WHEN (item DIV 4) % 10 = 7 THEN 'dev' "
                   "ELSE 'test' END").alias("split"),
            F.col("item").cast("string").alias("itemid"), F.lit("en").alias("orig_lang"),
            F.lit("['en', 'de', 'fr', 'es']").alias("available_langs")]
    for l in CORPUS_TEST_LANGS:
        doc = f"doc_{l}"
        cols += [
            *[c.alias(f"arg{n}_context_{l}") for n, c in enumerate(V.halves(f"text_{l}"), 1)],
            F.expr(f"CASE WHEN {doc} IS NOT NULL THEN 'reason_{l}' END").alias(f"MV_{l}"),
            F.expr(f"CASE WHEN {doc} IS NULL THEN NULL WHEN {doc} % 6 = 0 THEN {_dist_literal_sql(doc, True)} "
                   f"ELSE {_dist_literal_sql(doc, False)} END").alias(f"MV_dist_{l}"),
        ]
    return g.select(*cols)


def _corpus_sql() -> str:
    def lit(doc, short):
        return _dist_literal_sql(doc, short).replace("\\'", "''").replace("AS STRING", "AS VARCHAR")
    items = ", ".join(
        f"CASE WHEN lang = '{l}' THEN text END AS text_{l}, CASE WHEN lang = '{l}' THEN doc_id END AS doc_{l}"
        for l in CORPUS_TEST_LANGS)
    unp = "\n  UNION ALL ".join(
        f"SELECT item, '{l}' AS inst_lang, {S.halves('text_' + l)[0]} AS arg1, {S.halves('text_' + l)[1]} AS arg2, "
        f"CASE WHEN doc_{l} IS NOT NULL THEN 'reason_{l}' END AS mv, "
        f"CASE WHEN doc_{l} IS NULL THEN NULL WHEN doc_{l} % 6 = 0 THEN {lit('doc_' + l, True)} "
        f"ELSE {lit('doc_' + l, False)} END AS dist FROM g" for l in CORPUS_TEST_LANGS)
    tax = S.taxonomy_values().replace("tax AS (SELECT * FROM (VALUES ", "tax0 AS (SELECT * FROM (VALUES ")
    keys = ", ".join(f"({i}, '{k}')" for i, k in enumerate(tx.L3_SOURCE_KEYS))
    return f"""WITH g AS (SELECT doc_id AS item, {items} FROM documents),
u AS ({unp}),
p AS (SELECT *, json_transform(replace(dist, chr(39), '"'), '"MAP(VARCHAR, DOUBLE)"') AS m FROM u),
{tax},
tk AS (SELECT * FROM (VALUES {keys}) t(l3_idx, l3_key)),
tax AS (SELECT tax0.*, tk.l3_key FROM tax0 JOIN tk USING (l3_idx)),
lg AS (SELECT p.item, p.inst_lang, t.l3_idx, t.l2_idx, t.l1_idx, p.m[t.l3_key] AS v FROM p CROSS JOIN tax t),
nm AS (SELECT *, CASE WHEN v IS NULL THEN NULL WHEN sum(coalesce(abs(v), 0)) OVER w = 0 THEN v
                      ELSE v / sum(coalesce(abs(v), 0)) OVER w END AS pn
       FROM lg WINDOW w AS (PARTITION BY item, inst_lang)),
l2 AS (SELECT item, inst_lang, l2_idx, any_value(l1_idx) AS l1_idx,
              CASE WHEN count(pn) = count(*) THEN sum(pn) END AS v FROM nm GROUP BY item, inst_lang, l2_idx),
l1 AS (SELECT item, inst_lang, l1_idx, CASE WHEN count(v) = count(*) THEN sum(v) END AS v
       FROM l2 GROUP BY item, inst_lang, l1_idx),
m2 AS (SELECT item, inst_lang, l2_idx FROM (SELECT *, row_number() OVER (PARTITION BY item, inst_lang
        ORDER BY v DESC, l2_idx) AS rk FROM l2 WHERE v IS NOT NULL) WHERE rk = 1),
m1 AS (SELECT item, inst_lang, l1_idx FROM (SELECT *, row_number() OVER (PARTITION BY item, inst_lang
        ORDER BY v DESC, l1_idx) AS rk FROM l1 WHERE v IS NOT NULL) WHERE rk = 1),
n2 AS (SELECT DISTINCT l2_idx, l2 FROM tax), n1 AS (SELECT DISTINCT l1_idx, l1 FROM tax),
w1 AS (SELECT item, inst_lang, """ + ", ".join(
        f"max(CASE WHEN l1_idx = {i} THEN round(v, 6) END) AS {n}" for i, n in enumerate(tx.L1_NAMES)) + """
       FROM l1 GROUP BY item, inst_lang),
res AS (SELECT CAST(u.item AS VARCHAR) AS itemid, u.inst_lang,
               CASE WHEN (u.item // 4) % 10 < 7 THEN 'train' WHEN (u.item // 4) % 10 = 7 THEN 'dev' ELSE 'test' END AS split,
               u.arg1 || ' ' || u.arg2 AS arg1_arg2, n1.l1 AS majority_level_1, n2.l2 AS majority_level_2,
               regexp_replace(u.mv, '_(en|de|fr|cs)$', '') AS majority_level_3,
               """ + ", ".join(f"w1.{n}" for n in tx.L1_NAMES) + f"""
        FROM u LEFT JOIN m1 USING (item, inst_lang) LEFT JOIN n1 USING (l1_idx)
        LEFT JOIN m2 USING (item, inst_lang) LEFT JOIN n2 USING (l2_idx)
        LEFT JOIN w1 USING (item, inst_lang))
SELECT itemid, inst_lang, split, md5(arg1_arg2) AS text_md5, majority_level_1, majority_level_2, majority_level_3,
       {", ".join(tx.L1_NAMES)}
FROM res WHERE (inst_lang = 'en' OR majority_level_1 IS NOT NULL)
  AND regexp_matches(arg1_arg2, '[^{TX.WHITESPACE_CLASS}]')"""


@register("corpus_instances", _corpus_sql())
def corpus_instances(spark, sf):
    """Dataflow A end to end: wide item table -> markup removed -> unpivot
    -> parse / exclude / normalise / roll up / majority -> required labels
    -> blank texts dropped (one map-only plan after the item build)."""
    inst = C.prepare_instances(items_table(spark, sf), langs=CORPUS_TEST_LANGS)
    return inst.select("itemid", "inst_lang", "split", F.md5("arg1_arg2").alias("text_md5"),
                       "majority_level_1", "majority_level_2", "majority_level_3",
                       *[F.round(F.col("dist_l1")[i], 6).alias(n) for i, n in enumerate(tx.L1_NAMES)])


@register("corpus_train_test", """
SELECT mode, CAST(level AS INTEGER) AS level, name, true AS ok
FROM (VALUES ('Validation'), ('Testing')) m(mode) CROSS JOIN (VALUES (1), (2), (3)) l(level)
CROSS JOIN (VALUES ('accuracy'), ('batch_mean_js'), ('mean_js')) n(name)
UNION ALL SELECT 'Training', level, 'js', true FROM (VALUES (1), (2), (3)) l(level)
UNION ALL SELECT 'Training', 0, 'loss', true""")
def corpus_train_test(spark, sf):
    """Dataflows A + C end to end on the given tables: the item table built
    from ``documents`` is prepared and written partitioned (S6), the text
    encoder and soft-label heads are fitted on the training split, and the
    metrics come back (S9 table).  ``ok``: distances and accuracies in range; a distance for every tenth batch of the
    training split; the training loss falls at every step, and by a tenth in all."""
    from labeldist import jobs
    corpus = scratch_path(spark, "corpus-tt")
    K.write_corpus(C.prepare_instances(items_table(spark, sf), langs=CORPUS_TEST_LANGS), corpus)
    m = jobs.train_and_test(spark, corpus, "all", max_iter=30, out_path=scratch_path(spark, "run-tt"))
    n_train = spark.read.parquet(corpus).filter("split = 'train'").count()
    batches = -(-n_train // M.BATCH_SIZE)
    falls = F.array_sort(F.collect_list(F.struct("step", "value")))
    first, last = F.element_at("steps", 1)["value"], F.element_at("steps", -1)["value"]
    steady = F.forall(F.sequence(F.lit(1), F.size("steps") - 1), lambda i: F.element_at("steps", i)["value"] >= F.element_at("steps", i + 1)["value"])
    g = m.groupBy("mode", "level", "name").agg(falls.alias("steps"), F.min("value").alias("low"), F.max("value").alias("high"))
    ok = F.when(F.col("name") == "loss", steady & (last < 0.9 * first)).otherwise(
        (F.col("low") >= 0) & (F.col("high") <= F.when(F.col("name") == "accuracy", 100).otherwise(1))
        & ((F.col("name") != "js") | (F.size("steps") == -(-batches // M.LOG_EVERY))))
    return g.select("mode", "level", "name", ok.alias("ok"))


# --- sources: rows written as files, read by the readers --------------------------

@register("read_item_files", f"""
SELECT CAST(doc_id AS VARCHAR) AS itemid, lang, CASE WHEN (doc_id // 4) % 10 < 7 THEN 'train' WHEN (doc_id // 4) % 10 = 7 THEN 'dev' ELSE 'test' END AS split,
       md5({S.halves('text')[0]}) AS arg1_md5, md5({S.halves('text')[1]}) AS arg2_md5, 'reason_' || lang AS mv
FROM documents WHERE lang IN ({', '.join(f"'{x}'" for x in CORPUS_TEST_LANGS)})""")
def read_item_files(spark, sf):
    """The item table as tab-separated files with quoted line breaks, quotes and blanks, read again; the text of an item
    in its own language."""
    path = scratch_path(spark, "items 100%")
    (items_table(spark, sf).select(*R.item_columns(CORPUS_TEST_LANGS)).write.option("sep", "\t").option("header", True)
     .option("quote", '"').option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).option("nullValue", "").csv(path))
    d = R.read_items(spark, path, CORPUS_TEST_LANGS)
    one = F.inline(F.array(*[F.struct(
        F.lit(l).alias("lang"), F.nullif(f"arg1_context_{l}", F.lit("")).alias("a"), F.nullif(f"arg2_context_{l}", F.lit("")).alias("b"),
        F.nullif(f"MV_{l}", F.lit("")).alias("mv")) for l in CORPUS_TEST_LANGS]))
    return d.select("itemid", "split", one).filter(F.col("mv").isNotNull()).select(
        "itemid", "lang", "split", F.md5("a").alias("arg1_md5"), F.md5("b").alias("arg2_md5"), "mv")


@register("embed_input_checks", """
SELECT c.table_name AS tbl, max(CASE WHEN c.column_name = 'text' THEN 1 ELSE 0 END) = 1 AS accepted
FROM information_schema.columns c WHERE c.table_name IN ('documents', 'benchmark', 'conversations', 'pages', 'labels', 'events', 'embeddings')
GROUP BY c.table_name""")
def embed_input_checks(spark, sf):
    """M2: tables with a column ``text`` are accepted for embedding, others refused before any job runs."""
    from labeldist.operators import features as FE

    def accepted(name):
        try:
            FE.check_text_input(V.table(spark, sf, name), "text")
        except ValueError:
            return False
        return True
    names = ("documents", "benchmark", "conversations", "pages", "labels", "events", "embeddings")
    return spark.createDataFrame([(n, accepted(n)) for n in names], "tbl STRING, accepted BOOLEAN")
