"""Surrogates, line dedup and mixing."""

import re

from pyspark.sql import functions as F

from labeldist.llm import line_dedup, mixing, surrogates


# --- surrogates

def test_surrogates(spark):
    docs = spark.createDataFrame([
        (1, "Write to anna.b@mail.example.com or ANNA.B@MAIL.EXAMPLE.COM, call +1 (741) 555-3069 now."),
        (2, "Call +1-741-555-3069 or (741) 555-3060. Host 84.26.86.227. Card 4539 1488 0343 6467, 4539148803436467, 1353681299978555."),
        (3, 'token = "27660c51feb63980dfaee7464f96210544c03fc3" and Mrs. Maria Gomez met Mr Gomez and Frau MARIA GOMEZ.'),
        (4, "Господин? господин Иван Петров пришёл. Version 1.2.3, year 2024, 12 apples, 3.14, 10:30."),
        (5, None), (None, "")], "doc_id LONG, text STRING")
    got = {r.doc_id: r for r in surrogates.pseudonymise(docs).collect()}
    one, two, three, four = (got[i].text for i in (1, 2, 3, 4))
    mails = re.findall(r"\S+@[\w.]*\w", one)
    assert mails[0].upper() == mails[1] and mails[0] != "anna.b@mail.example.com"
    phone = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4})", one).groups()
    assert re.search(r"\+1-(\d{3})-(\d{3})-(\d{4})", two).groups() == phone != ("741", "555", "3069")
    assert all(0 < int(x) < 255 for x in re.search(r"Host (\d+)\.(\d+)\.(\d+)\.(\d+)\.", two).groups())
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", two)
    assert cards[0].replace(" ", "") == cards[1] != cards[2]

    def luhn(x):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(x))) % 10
    assert luhn(cards[1]) == 0 and luhn(cards[2]) != 0
    assert re.search(r'token = "[0-9a-f]{40}"', three) and "27660c51" not in three
    a, b, c, d, e = re.search(r"Mrs\. (\w+) (\w+) met Mr (\w+) and Frau (\w+) (\w+)\.", three).groups()
    assert b == c and (a.upper(), b.upper()) == (d, e) and a.endswith("a") and "Gomez" not in three
    name = re.search(r"господин (\w+) (\w+) пришёл", four)
    assert re.fullmatch("[А-Яа-я]+", name[1]) and name[1].endswith("ий") and name[1] != "Иван"
    assert four.endswith("Version 1.2.3, year 2024, 12 apples, 3.14, 10:30.") and got[5].text is None and got[None].text == ""
    assert surrogates.pseudonymise(docs, key="other").filter("doc_id = 1").first().text != one


def test_surrogates_stay_distinct(spark):
    n = 3000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("at 10.0."), (F.col("id") % 50).cast("string"), F.lit("."), F.floor(F.col("id") / 50).cast("string"), F.lit(" x")).alias("text"))
    out = [r.text for r in surrogates.pseudonymise(docs).collect()]
    before = {r.text for r in docs.collect()}
    assert len(set(out)) == n and not before & set(out)


def test_a_taken_surrogate_is_drawn_again(spark):
    kind, value = F.lit("ssn"), F.lit("123456789")
    first = spark.range(1).select(surrogates.candidate(kind, value, F.lit("-"), F.lit(0)).alias("c")).first().c
    entities = spark.createDataFrame([("ssn", "123456789", "-"), ("ssn", first, "-")], "kind STRING, value STRING, gender STRING")
    got = {r.value: r.surrogate for r in surrogates.assign(entities).collect()}
    assert got["123456789"] != first and len(set(got.values()) | set(got)) == 4


def test_surrogate_edges(edge_docs, no_docs):
    out = surrogates.pseudonymise(edge_docs)
    assert sorted(map(str, out.select(*edge_docs.columns).filter("doc_id is null or doc_id <> 7").collect())) == sorted(
        map(str, edge_docs.filter("doc_id is null or doc_id <> 7").collect()))
    assert surrogates.pseudonymise(no_docs).count() == 0


# --- line dedup

def windows_removed(texts):
    seen, out = set(), []
    for t in texts:
        lines = (t or "").split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i:i + 3])
            if all(not x.strip(" ") for x in w):
                continue
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        out.append(None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_line_windows(spark):
    texts = ["a\nb\nc\nd", "x\na\nb\nc\nd\ny", "a\nb\nc", "a\nb", "q\nr\ns\nq\nr\ns\nt", "r\ns\nt\n\n\n\n", "\n\n\n\n\n", "m\nm\nm\nm\nm", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert [got[i] for i in range(len(texts))] == windows_removed(texts)
    kept = {r.doc_id for r in line_dedup.without_repeated_lines(docs).collect()}
    assert kept == set(range(len(texts))) - {2, 5}   # of these only blank lines are left


def test_line_edges(edge_docs, no_docs):
    out = line_dedup.dedup_lines(edge_docs)
    assert out.columns[:-2] == edge_docs.columns and out.count() == edge_docs.count()
    rows = out.collect()
    assert sorted(r.text for r in rows if r.doc_id in (1, 2))[:2] == ["", ""]     # copies of rows and texts: one stays
    assert sorted(len(r.text) for r in rows if r.doc_id is None)[0] == 0
    assert [r.text for r in rows if r.doc_id == 3] == [None] and [r.text for r in rows if r.doc_id == 5] == [" \n\t \n\n "]
    assert line_dedup.dedup_lines(no_docs).count() == 0


# --- mixing

def test_targets_are_met_by_nested_thresholds(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.col("id").cast("int") % 9).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    taken = {}
    for share in (0.4, 0.8, 1.5):
        rows = mixing.mix(docs, share=share).collect()
        assert len(rows) == 6000
        for s in {r.source for r in rows}:
            mine = [r for r in rows if r.source == s]
            assert abs(sum(r["__size"] * r["__repeats"] for r in mine) - mine[0]["__target"]) <= 8
            assert mine[0]["__target"] <= 2 * mine[0]["__source_size"] + 1e-6
        total = sum({r.source: r["__target"] for r in rows}.values())
        assert abs(total - share * sum(r["__size"] for r in rows)) < 1e-3
        now = {r.doc_id: r["__repeats"] for r in rows}
        assert all(now[i] >= taken.get(i, 0) for i in now)
        taken = now
    assert mixing.mixed(docs).count() == sum(taken.values())


def test_mixing_edges(edge_docs, no_docs):
    out = mixing.mix(edge_docs)
    assert out.count() == edge_docs.count() and set(edge_docs.columns) <= set(out.columns)
    rows = out.collect()
    assert {r["__size"] for r in rows if r.doc_id in (3, 4, 5)} == {0}
    assert len({r["__target"] for r in rows if r.source is None}) == 1
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).columns == no_docs.columns
