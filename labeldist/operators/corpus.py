"""Dataflow A: crowd-annotated multilingual items -> training instances.

One lazy plan: ``strip_markup -> unpivot_langs -> parse / exclude / normalise
/ roll up / argmax -> require_label -> drop_blank``.  The unpivot comes first,
so every distribution expression exists once (not once per language) and the
whole preparation is map-only: no shuffle until the partitioned write.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labeldist import taxonomy as tx
from labeldist.functions import distributions as D
from labeldist.functions import text as TX

# --- fixed values ------------------------------------------------------------
CORPUS_LANGS = ["en", "de", "fr", "cs"]
# Languages whose instances are kept even without a majority label.
KEEP_UNLABELLED = ["en"]
# Per-language source columns of the item table ({l} = language code).
ITEM_FIELDS = {
    "arg1": "arg1_context_{l}",
    "arg2": "arg2_context_{l}",
    "majority_level_3": "MV_{l}",
    "dist": "MV_dist_{l}",
}
ITEM_META = ["split", "itemid", "orig_lang", "available_langs"]
# -----------------------------------------------------------------------------


def strip_markup_all(df: DataFrame, tag: str = "SPEAKER") -> DataFrame:
    """P2 over every string column of ``df``."""
    return df.select(*[TX.strip_markup(f.name, tag).alias(f.name)
                       if isinstance(f.dataType, T.StringType) else F.col(f.name)
                       for f in df.schema.fields])


def conform(df: DataFrame, columns: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Select, reorder and rename (``{source: target}`` or a name list)."""
    if isinstance(columns, Mapping):
        return df.select(*[F.col(s).alias(t) for s, t in columns.items()])
    return df.select(*columns)


def unpivot_langs(df: DataFrame, langs: Iterable[str] = CORPUS_LANGS,
                  fields: Mapping[str, str] = ITEM_FIELDS,
                  keep: Sequence[str] = ITEM_META, lang_col: str = "inst_lang") -> DataFrame:
    """U1 (+P18): wide per-language blocks -> one row per item and language.

    A single ``inline(array(struct ...))`` expansion: one scan, no union of
    per-language scans and no shuffle.
    """
    structs = [F.struct(F.lit(l).alias(lang_col),
                        *[F.col(pat.format(l=l)).alias(name) for name, pat in fields.items()])
               for l in langs]
    return df.select(*keep, F.inline(F.array(*structs)))


def union_langs(dfs: Sequence[DataFrame]) -> DataFrame:
    """Stack separately loaded language tables (columns matched by name)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def with_distribution_levels(df: DataFrame, dist_col: str = "dist",
                             vocab: Sequence[str] = tx.L3_SOURCE_KEYS,
                             exclude: str = tx.EXCLUDED_LABEL,
                             recompute_l3: bool = False) -> DataFrame:
    """P5, P8, P7, D1, D2, D3, D4 on a distribution literal column.

    Adds ``dist_l3`` (28), ``dist_l2`` (17), ``dist_l1`` (4) and the
    majority labels of levels 1 and 2 (first maximum, NULLs skipped).  The
    level-3 majority stays the corpus value unless ``recompute_l3``.
    """
    m = D.exclude_label(D.parse_distribution(dist_col), exclude)
    out = df.withColumn("dist_l3", D.l1_normalize(D.align_distribution(m, vocab)))
    out = out.withColumn("dist_l2", D.rollup_level("dist_l3", 2))
    out = out.withColumn("dist_l1", D.rollup_level("dist_l2", 1))
    out = out.withColumn("majority_level_1", D.argmax_label("dist_l1", tx.L1_NAMES))
    out = out.withColumn("majority_level_2", D.argmax_label("dist_l2", tx.L2_NAMES))
    if recompute_l3:
        out = out.withColumn("majority_level_3", D.argmax_label("dist_l3", tx.L3_NAMES))
    return out


def require_label(df: DataFrame, keep_unlabelled: Sequence[str] = KEEP_UNLABELLED,
                  label_col: str = "majority_level_1", lang_col: str = "inst_lang") -> DataFrame:
    """drop instances without a majority label, except for ``keep_unlabelled``."""
    return df.filter(F.col(lang_col).isin(list(keep_unlabelled)) | F.col(label_col).isNotNull())


def drop_blank(df: DataFrame, col: str = "arg1_arg2") -> DataFrame:
    """drop NULL, empty and white-space-only texts."""
    return df.filter(~TX.is_blank(col))


def split(df: DataFrame, name: str, col: str = "split") -> DataFrame:
    """rows of one split (``train``/``dev``/``test``)."""
    return df.filter(F.col(col) == F.lit(name))


def splits(df: DataFrame, names: Sequence[str], col: str = "split") -> DataFrame:
    """F1 for several splits at once (one scan, one filter)."""
    return df.filter(F.col(col).isin(list(names)))


def prepare_instances(items: DataFrame, langs: Sequence[str] = CORPUS_LANGS,
                      keep_unlabelled: Sequence[str] = KEEP_UNLABELLED,
                      markup_tag: str = "SPEAKER", recompute_l3: bool = False) -> DataFrame:
    """The whole of dataflow A on an all-string item table (see S1).

    Output: ``split, itemid, orig_lang, available_langs ARRAY<STRING>,
    inst_lang, arg1, arg2, arg1_arg2, majority_level_1/2/3, dist_l1/l2/l3``.
    """
    df = strip_markup_all(items, markup_tag)
    df = unpivot_langs(df, langs)
    df = df.withColumn("arg1_arg2", TX.pair_text("arg1", "arg2"))
    df = df.withColumn("available_langs", D.parse_list("available_langs"))
    df = with_distribution_levels(df, "dist", recompute_l3=recompute_l3)
    df = require_label(df, keep_unlabelled)
    df = drop_blank(df, "arg1_arg2")
    df = df.withColumn("majority_level_3", TX.strip_suffix("majority_level_3"))
    return df.select("split", "itemid", "orig_lang", "available_langs", "inst_lang",
                     "arg1", "arg2", "arg1_arg2", "majority_level_1", "majority_level_2",
                     "majority_level_3", "dist_l1", "dist_l2", "dist_l3")


def to_wide(df: DataFrame) -> DataFrame:
    """The 60-column layout (one column per sense, in taxonomy order)."""
    cols = [F.col(c) for c in ("split", "itemid", "orig_lang", "available_langs", "inst_lang",
                               "arg1", "arg2", "arg1_arg2", "majority_level_1")]
    cols += [F.col("dist_l1")[i].alias(n) for i, n in enumerate(tx.L1_NAMES)]
    cols += [F.col("majority_level_2")]
    cols += [F.col("dist_l2")[i].alias(n) for i, n in enumerate(tx.L2_NAMES)]
    cols += [F.col("majority_level_3")]
    cols += [F.col("dist_l3")[i].alias(n) for i, n in enumerate(tx.L3_NAMES)]
    return df.select(*cols)
