"""Text functions, annotation parsing, sources on temporary files."""

import os

import pytest

from labeldist import taxonomy as tx
from labeldist.functions import annotation as A
from labeldist.functions import text as TX
from labeldist.operators import corpus as C
from labeldist.operators import standoff as SO
from labeldist.sources import readers as R


def test_blank_text_dropped(spark):
    df = spark.createDataFrame([(1, "\t\n"), (2, " "), (3, None), (4, " "), (5, " a ")], "id INT, t STRING")
    assert [r.id for r in C.drop_blank(df, "t").collect()] == [5]


def test_pair_text_null_propagates(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None)], "x STRING, y STRING")
    assert [r[0] for r in df.select(TX.pair_text("x", "y")).collect()] == ["a b", None]


def test_two_span_slice(spark):
    df = spark.createDataFrame([("abcdefgh", "0..3;5..7")], "t STRING, s STRING")
    assert df.select(A.slice_spans("t", A.parse_spans("s"))).first()[0] == "abc fg"


def test_two_level_sense(spark):
    df = spark.createDataFrame([("Expansion.Conjunction",), ("Contingency.Cause.Reason",), (None,)], "s STRING")
    rows = df.select(A.split_sense("s").alias("x")).select("x.*").collect()
    assert tuple(rows[0]) == ("Expansion", "Conjunction", None, "Conjunction")
    assert tuple(rows[1]) == ("Contingency", "Cause", "Reason", "Reason")
    assert tuple(rows[2]) == (None, None, None, None)


def line(rel, sense, conn2="", sense2="", a1="0..3", a2="5..7"):
    f = [""] * 22
    f[0], f[7], f[8], f[10], f[11], f[14], f[20] = rel, "because", sense, conn2, sense2, a1, a2
    return "|".join(f)


def test_second_sense_only_on_implicit(spark):
    df = spark.createDataFrame([(line("Explicit", "Expansion.Conjunction", "so", "Contingency.Cause.Result"),),
                                (line("Implicit", "Expansion.Conjunction", "so", "Contingency.Cause.Result"),)],
                               "line STRING")
    rows = df.select(A.parse_second_sense("line").alias("m")).select("m.*").collect()
    assert tuple(rows[0]) == (None, None)
    assert tuple(rows[1]) == ("so", "Contingency.Cause.Result")


def test_strip_suffix_and_short_name(spark):
    df = spark.createDataFrame([("cause_en", "org/model-a"), ("cause_es", "plain")], "l STRING, m STRING")
    got = df.select(TX.strip_suffix("l"), TX.short_name("m")).collect()
    assert [tuple(r) for r in got] == [("cause", "model-a"), ("cause_es", "plain")]


def test_standoff_tree_end_to_end(spark, tmp_dir):
    gold, raw = os.path.join(tmp_dir, "gold"), os.path.join(tmp_dir, "raw")
    for d in (gold, raw):
        os.makedirs(os.path.join(d, "00"))
    os.makedirs(os.path.join(gold, ".hidden"))
    text = "abcdefgh\r\nijklmnop  \n\n"
    with open(os.path.join(raw, "00", "wsj_0001"), "wb") as fh:
        fh.write(text.encode("iso-8859-1"))
    with open(os.path.join(gold, "00", "wsj_0001"), "w") as fh:
        fh.write(line("Implicit", "Expansion.Conjunction", "so", "Contingency.Cause.Result", "0..3;5..7", "9..12") + "\n")
        fh.write("EntRel|x\n")
        fh.write(line("Explicit", "Temporal.Asynchronous.Precedence", a1="0..2", a2="10..13") + "\n")
    with open(os.path.join(gold, ".hidden", "wsj_0001"), "w") as fh:
        fh.write(line("Explicit", "Temporal.Synchronous") + "\n")
    ann = R.read_annotations(spark, gold)
    docs = R.read_raw_docs(spark, raw)
    rel = SO.build_relations(ann, docs)
    rows = {r.relation: r for r in rel.collect()}
    assert set(rows) == {"Implicit", "Explicit"}
    imp = rows["Implicit"]
    assert (imp.folder, imp.file) == ("00", "wsj_0001")
    assert imp.arg1 == "abc fg" and imp.arg2 == "ijk"   # \r\n counts as one character
    assert imp.multi_sense1 == "Contingency" and imp.multi_sense_final == "Result"
    assert imp.conjunction == 1.0 and imp.expansion == 1.0 and imp.cause == 0.0
    exp = rows["Explicit"]
    assert exp.multi_sense is None and exp.sense_final == "Precedence" and exp.asynchronous == 1.0
    assert exp.arg2 == "jkl"
    assert SO.single_sense(rel).count() == 1


def test_items_tsv_end_to_end(spark, tmp_dir):
    header = R.item_columns() + ["extra"]
    full = {k: 0.0 for k in tx.L3_SOURCE_KEYS}
    full.update({"reason": 6, "result": 2, "norel": 2})
    dist = "{" + ", ".join(f"'{k}': {v}" for k, v in full.items()) + "}"
    rows = []
    for i, split in enumerate(["train", "dev", "test"]):
        r = {"split": split, "itemid": str(i), "orig_lang": "en", "available_langs": "['en', 'de']", "extra": "x"}
        for l in ["en", "de", "fr", "cs"]:
            r.update({f"arg1_context_{l}": f"<SPEAKER id=1>first {l}", f"arg2_context_{l}": f"second {l}",
                      f"MV_{l}": f"reason_{l}", f"MV_dist_{l}": dist if l in ("en", "de") else ""})
        rows.append(r)
    rows[1]["arg1_context_en"] = "\"\t\""
    rows[1]["arg2_context_en"] = " "
    rows[2]["MV_dist_en"] = ""          # no distribution: kept for English only
    rows[2]["MV_dist_de"] = ""
    path = os.path.join(tmp_dir, "items.tsv")
    with open(path, "w") as fh:
        fh.write("\t".join(header) + "\n")
        for r in rows:
            fh.write("\t".join(r[h] for h in header) + "\n")
    inst = C.prepare_instances(R.read_items(spark, path))
    got = {(r.itemid, r.inst_lang): r for r in inst.collect()}
    # fr/cs have no distribution -> dropped; en kept; item 1 en is blank -> dropped;
    # item 2 has no distribution at all -> kept for en (NULL labels), dropped for de
    assert set(got) == {("0", "en"), ("0", "de"), ("1", "de"), ("2", "en")}
    r2 = got[("2", "en")]
    assert r2.majority_level_1 is None and all(v is None for v in r2.dist_l3)
    r = got[("0", "en")]
    assert r.arg1 == "first en" and r.arg1_arg2 == "first en second en"
    assert r.available_langs == ["en", "de"]
    assert r.dist_l3[3] == pytest.approx(0.75) and r.dist_l3[4] == pytest.approx(0.25)
    assert r.dist_l2[2] == pytest.approx(1.0) and r.dist_l1[1] == pytest.approx(1.0)
    assert (r.majority_level_1, r.majority_level_2, r.majority_level_3) == ("contingency", "cause", "reason")
    wide = C.to_wide(inst)
    assert len(wide.columns) == 9 + 4 + 1 + 17 + 1 + 28


def test_read_prompts(spark, tmp_dir):
    for l in ("en", "de"):
        with open(os.path.join(tmp_dir, f"main_prompt_{l}.txt"), "w") as fh:
            fh.write(f"line one {l}\nline two\n")
    got = {r.lang: r.prompt for r in R.read_prompts(spark, tmp_dir).collect()}
    assert got == {"en": "line one en\nline two\n", "de": "line one de\nline two\n"}


def test_embed_input_checks(spark):
    from labeldist.operators.features import embed
    with pytest.raises(ValueError):
        embed("not a frame", "text")
    with pytest.raises(ValueError):
        embed(spark.createDataFrame([(1,)], "x INT"), "text")


def test_nth_line(spark):
    df = spark.createDataFrame([("a\nb\nc",), ("one",), ("x\n",), ("",), (None,)], "t STRING")
    got = [tuple(r) for r in df.select(TX.line("t", 1), TX.line("t", 2), TX.line("t", 3)).collect()]
    assert got == [("a", "b", "c"), ("one", "", ""), ("x", "", ""), ("", "", ""), (None, None, None)]


def test_hot_document_join_is_exact(spark):
    # one document carries a third of all annotation lines: the salted join
    # gives exactly the plain join's rows
    lines = [("00", "hot" if i % 3 == 0 else f"f{i % 40}",
              line("Implicit", "Expansion.Conjunction", "so", "Contingency.Cause.Result", f"{i % 5}..{i % 5 + 3}", "4..8"))
             for i in range(600)]
    ann = spark.createDataFrame(lines, "folder STRING, file STRING, line STRING")
    docs = spark.createDataFrame([("00", "hot", "abcdefghijklmnop")] + [("00", f"f{i}", f"text number {i}") for i in range(40)],
                                 "folder STRING, file STRING, text STRING")
    rel = SO.parse_lines(ann)
    salted = SO.attach_text(rel, docs, hot_share=0.05).select("file", "arg1", "arg2").collect()
    plain = SO.attach_text(rel, docs, hot_share=None).select("file", "arg1", "arg2").collect()
    assert sorted(map(tuple, salted)) == sorted(map(tuple, plain)) and len(salted) == 600
