from __future__ import annotations

from clusterloom.llm import template_decontamination as t
from clusterloom.llm.queries import QUERIES

ITEM = "A train leaves the old station at 9 km from Berlin and then Maria waits 30 minutes for Jonas before Maria walks 9 km home"
FILL = "some quiet words about nothing in particular that go on for a while without any meaning"


def test_templates_and_slots(spark):
    swap = ITEM.replace("9", "17").replace("Berlin", "Paris").replace("Maria", "Anna").replace("Jonas", "Peter").replace("minutes", "hours")
    mixed = swap.replace("before Anna", "before Peter")
    docs = [
        (1, f"{FILL}. {ITEM}. {FILL}"), (2, f"{FILL}. {swap}. {FILL}"), (3, f"{FILL}. " * 50), (4, None), (5, ""),
        (6, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"), (7, " ".join(ITEM.split()[:9])), (1, f"{FILL}. {ITEM}. {FILL}"), (None, swap),
        (8, "In short: short item of five words"), (9, " ".join(ITEM.split()[3:17])), (10, "x " * 200000 + swap),
    ]
    frame = spark.createDataFrame([(i, x, 7) for i, x in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(10, ITEM, "k"), (10, ITEM, "k"), (11, "Short item of five words", "k"), (12, None, "k"), (13, "7 8", "k")],
                                  "item_id long, text string, kind string")
    rows = sorted((repr(r.doc_id), r.contaminated, r.item_id, r.kind) for r in t.flag(frame, bench).collect())
    hit = {"1": (10, "exact"), "2": (10, "reparameterised"), "None": (10, "reparameterised"), "8": (11, "exact"),
           "9": (10, "exact"), "10": (10, "reparameterised")}
    assert rows == sorted((repr(i), repr(i) in hit, *hit.get(repr(i), (None, None))) for i, _ in docs)
    kept = t.clean(frame, bench)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7]
    # Slots that do not map one-to-one are no evidence unless the other words suffice.
    one = spark.createDataFrame([(1, mixed)], "doc_id long, text string")
    assert t.flag(one, bench, min_cover=20).first().contaminated is False
    assert t.flag(one, bench, min_cover=13).first().contaminated is True


def found(spark, items, docs):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return {r.doc_id: (r.item_id, r.kind) for r in t.flag(frame, bench).collect() if r.contaminated}


def test_names_wherever_they_stand(spark):
    items = ["Maria has 5 apples. Maria buys 3 more. How many apples does Maria have?",
             "Tom Miller walks slowly along the river until Tom Miller reaches the old mill near Bonn",
             "Gravity pulls every falling stone down"]
    docs = [
        f"{FILL}. " + items[0].replace("Maria", "Anna") + f" {FILL}",
        f"{FILL} Question " + items[0].replace("Maria", "Anna") + f" {FILL}",
        items[1].replace("Tom Miller", "Eve"), items[1].replace("Tom Miller", "Jo Ann Hill"),
        *(f"{FILL} {mark} {items[2]} {FILL}" for mark in ("-", "|", "(", "and")),
        items[0].replace("Maria buys", "Anna buys").replace("Maria have", "Eve have"), f"{FILL}. Gravity pulls every falling leaf down",
    ]
    same = "reparameterised"
    got = found(spark, items, docs)
    assert {i: got[i] for i in range(4)} == {0: (0, same), 1: (0, same), 2: (1, same), 3: (1, same)}
    assert {i: got[i] for i in range(4, 8)} == dict.fromkeys(range(4, 8), (2, "exact"))
    assert 9 not in got


def test_verbatim_copies_full_of_placeholders(spark):
    items = ["What is 12 plus 30?", "3 1 4 1 5 9 2 6 5 3 5 8 9 7 9", "Anna, Ben, Carl, Dora, Eve, Fay, Gus, Hal, Ida, Jan, Kim, Leo, Max and Nora",
             "Der Lehrer gibt dem Kind Hefte Stifte Bücher Karten Bilder Kreide Papier und Farben", "5 6 7 8"]
    docs = [f"{FILL} {x} {FILL}" for x in items] + ["What is 13 plus 31?", "3 1 4 1 5 9 2 7 5 3 5 8 9 7 9", items[2].replace("Gus", "Gil")]
    assert found(spark, items, docs) == {i: (i, "exact") for i in range(5)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert t.flag(docs, bench.limit(0)).first().contaminated is False
    assert t.flag(docs.limit(0), bench).count() == 0


def test_query_finds_inserted_items(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    holds = {d.doc_id for d in docs if any(x in " ".join((d.text or "").split()) for x in items)}
    got = {r.doc_id: r.contaminated for r in QUERIES["op10_template_decontamination"](spark, sf_dir).collect()}
    assert len(got) == len(docs) and holds and holds <= {i for i, x in got.items() if x}
    assert sum(got.values()) <= len(holds) + 2
