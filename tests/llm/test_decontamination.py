from llm_rows import shipped  # noqa: F401

from sealdex.llm.decontamination import contaminated
from sealdex.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string"
ITEM = "A farmer named Alice had 12 red apples and gave Bob 5 kg of them before Alice walked 3 miles home to sleep"


def run(spark, docs, items):
    got = contaminated(spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS), spark.createDataFrame(items, ITEMS)).collect()
    return {(r.doc_id, r.item_id): r.reparameterised for r in got}


def test_reparameterised_and_inconsistent(shipped):
    other = ITEM.replace("Alice", "Carol").replace("Bob", "Dave").replace("12", "7").replace("5 kg", "9 lb").replace("3 miles", "44 km")
    swapped = ITEM.replace("had 12", "had 8").replace("Alice walked", "Zoe walked")
    docs = [
        (1, f"Some words first. {ITEM} and then more."), (2, f"Some words first. {other}. The end"), (3, swapped), (4, "He had 12 red apples and gave her 5 kg"),
        (5, None), (6, ""), (7, ITEM.lower()), (8, ITEM), (8, ITEM), (None, ITEM), (9, "1 2 3 4 5 6 7 8 9 " * 50),
    ]
    got = run(shipped, docs, [(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, "the"), (5, "1 2 3 4 5 6 7 8 9 10")])
    assert got == {(1, 1): False, (2, 1): True, (8, 1): False} or got == {(1, 1): False, (2, 1): True, (7, 1): False, (8, 1): False}


def test_short_items(shipped):
    assert run(shipped, [(1, "so he said five little words here and left"), (2, "five little words there")], [(9, "five little words here and")]) == {(1, 9): False}


def test_items_too_short_for_windows_are_held_as_whole_lines(shipped):
    docs = [(1, "Some text.\n  Name  the CAPITAL \nmore"), (2, "so name the capital then"), (3, "name the capital"), (3, "name the capital"), (None, "name the capital"), (4, None), (5, "")]
    assert run(shipped, docs, [(7, "Name the capital"), (8, " "), (9, None)]) == {(1, 7): False, (3, 7): False}


def test_copies_however_they_are_set(shipped):
    """Running text, other line ends, other case, dense items, a word put in, part of a long item."""
    capital, dense = "What is the capital of France", "Anna Bert Carl 12 13 14 15 Dora 16 17 Emil 18"
    long = " ".join(f"word{i} as{i}" for i in range(100))
    wrapped = ITEM.replace(" Alice had", "\nAlice had").replace(" Bob", "\nBob").replace(" walked", "\nwalked")
    medium = [f"of{i}x" for i in range(31)]
    items = [(1, ITEM), (2, capital), (3, dense), (4, long), (5, " ".join(medium))]
    docs = [
        (1, f"as asked, {capital} and so on"), (2, f"he read: so {capital.upper()} again"), (3, wrapped), (4, ITEM.lower()), (5, ITEM.upper()),
        (6, f"list {dense} end"), (7, "list " + dense[: len(dense) // 2]), (8, " ".join([*medium[:15], "really", *medium[15:]])),
        (9, "so " + " ".join(long.split()[40:80]) + " end"), (10, "so " + " ".join(long.split()[40:55]) + " end"),
    ]
    got = run(shipped, docs, items)
    assert got == {k: False for k in [(1, 2), (2, 2), (3, 1), (4, 1), (5, 1), (6, 3), (8, 5), (9, 4)]}


def test_query_finds_planted_passages_and_nothing_else(shipped):
    docs = {r.doc_id: r.text for r in shipped.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in shipped.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, own in items.items() if " ".join(own.split()) in " ".join(t.split())}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_decontamination"](shipped, SF_DIR).collect()}
    assert want <= got
    folded = {(d, i) for d, t in docs.items() for i, own in items.items() if " ".join(own.lower().split()[2:-2]) in " ".join(t.lower().split())}
    assert got <= want | folded


def test_empty_tables(shipped):
    assert run(shipped, [], [(1, ITEM)]) == {} and run(shipped, [(1, ITEM)], []) == {}
