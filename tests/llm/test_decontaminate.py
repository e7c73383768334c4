from cohorte.llm.decontaminate import contamination, decontaminated

ITEM = "Maria bought 12 apples and 7 pears at the market, then she gave 5 kg of fruit to Omar before the shop closed at night."
SAME = "A tale. Yesterday, Maria bought 30 apples and 9 pears at the market, then she gave 4 kg of fruit to Peter before the shop closed at night. The end."
TWICE = "In the yard Anna has 5 red boxes and each of the 5 red boxes holds 8 small green balls for the game"
BAD = "In the yard Anna has 6 red boxes and each of the 9 red boxes holds 4 small green balls for the game"
GOOD = "In the yard Bella has 6 red boxes and each of the 6 red boxes holds 4 small green balls for the game"
NUMBERS = " ".join(str(i) for i in range(60))


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_reparameterised_items_are_found(spark, messy):
    bench = items(spark, [(1, ITEM), (2, TWICE), (3, NUMBERS), (4, "too few words"), (5, "six words are enough evidence here"), (6, None), (None, ITEM), (1, ITEM)])
    texts = [(1, ITEM), (2, SAME), (3, TWICE), (4, BAD), (5, GOOD), (6, NUMBERS + " 7 8 9"), (7, "too few words"), (8, "Then: six words are enough evidence here, indeed."), (9, None), (10, ""), (None, ITEM), (2, SAME), (11, "six words are enough")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, words string")
    got = {r.doc_id: (r.contaminated, r["items"]) for r in contamination(docs, bench).collect()}
    assert got == {1: (True, "1"), 2: (True, "1"), 3: (True, "2"), 4: (False, ""), 5: (True, "2"), 6: (True, "3"), 7: (False, ""), 8: (True, "5"), 9: (False, ""), 10: (False, ""), None: (False, ""), 11: (False, "")}
    left = decontaminated(docs, bench)
    assert left.columns == docs.columns and sorted((r.doc_id or 0) for r in left.collect()) == [0, 4, 7, 9, 10, 11]
    assert contamination(messy, bench).count() == messy.count()


def test_verbatim_copies_are_found_wherever_they_stand(spark):
    capital = "What is the capital of France"
    dense = "Anna 3 Omar 4 Paris 5 Kim 6 Rome 7 Lena 8 Oslo 9 Bern 10 Jan 11 Lima 12 Ida 13 Cork 14"
    tale = " ".join(f"word{i} goes" for i in range(9)) + " on. " + ITEM
    bench = items(spark, [(1, capital), (2, dense), (3, tale), (4, NUMBERS)])
    texts = [
        (1, f"the question is {capital} and so on"),
        (2, f"1 {capital.upper()}"),
        (3, "in\n  WHAT is\tthe capital of  France?"),
        (4, f"x {dense} y"),
        (5, "before " + " ".join(tale.split()[10:24]) + " after"),  # 14 words of a longer item
        (6, "before " + " ".join(tale.split()[10:21]) + " after"),  # 11 words
        (7, "What is the capital in France"),
        (8, " ".join(str(i) for i in range(59, -1, -1))),
    ]
    got = {r.doc_id: r["items"] for r in contamination(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    assert got == {1: "1", 2: "1", 3: "1", 4: "2", 5: "3", 6: "", 7: "", 8: ""}


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    bench = items(spark, [(1, ITEM), (2, TWICE), (3, NUMBERS)])
    docs = spark.createDataFrame([(1, ITEM), (2, SAME), (3, GOOD), (4, BAD), (5, NUMBERS)], "doc_id long, text string")
    want = sorted(map(tuple, contamination(docs, bench).collect()))
    monkeypatch.setattr("cohorte.llm.decontaminate.BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, contamination(docs, bench).collect())) == want


def test_empty(spark, messy, no_docs):
    none = items(spark, [])
    assert contamination(no_docs, none).count() == 0
    assert contamination(messy, none).filter("contaminated").count() == 0
    assert decontaminated(messy, none).count() == messy.count()


def test_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = {i.item_id: i.text for i in bench.collect()}
    expected = {d.doc_id: {i for i, t in whole.items() if t in d.text} for d in docs.collect()}
    for r in contamination(docs, bench).collect():
        assert {int(i) for i in r["items"].split(",") if i} >= expected[r.doc_id]
        assert r.contaminated == bool(expected[r.doc_id])
