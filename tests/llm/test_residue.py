"""Residue on pages, look-alikes, damage and propagation of labels."""

import pytest

from astrolith.llm import residue

ARTICLE = "The water rose by 22 inches in one\nnight and reached the cellar of Lamri\nQuinpaik. It is reported from Hesmann\nthat 870 houses stand empty since\nJuly, which nobody denies.\n"
RESIDUE = [
    "404 Not Found. The requested page could\nnot be located on this server.", "Please enable JavaScript to view this page.",
    ARTICLE + "Bitte aktivieren Sie JavaScript,\num diese Zeitungsseite anzuzeigen.\n" + ARTICLE, "A sale at {{byline}} Morik today\n" + ARTICLE,
    ARTICLE + "${edition.date}", "[INSERT CAPTION]\n" + ARTICLE, "%%HEADLINE%%", "SAMPLE TEXT SAMPLE TEXT SAM-\nPLE TEXT\n" + ARTICLE,
    "Lorem ipsum dolor sit amet, consectetur\nadipiscing elit sed do eiusmod tempor\nincididunt ut labore et dolore magna", "<name> was seen at\n" + ARTICLE,
]
HARMLESS = [
    ARTICLE, "", " ", "A printer in Morik still sets the words\nlorem ipsum when Elri Verzen tries new\ntype.", "The curly marks { } in the ledger puzzle\nall.",
    "An engineer explained why the error 404\nappears on his new machine.", "The bill named Sel Pavik [signed with a\ncross] and 54 others.",
    "He would not enable the script of the\nplay to be changed.", "The cashier [420 Taler] ran off.", "LO$T, a grey dog. & $ONS",
]


@pytest.fixture(scope="module")
def pages(spark):
    damaged = ["404 Nof Fonnd. The reqvested paqe could\nnot be locatcd on this scrver.", "Plcase enablc JavaScnipf to vlew this paqe."]
    rows = [(i, t, [{"x": 1, "y": 1, "w": 9, "h": 9, "conf": 9}] * len(t.split("\n"))) for i, t in enumerate(RESIDUE + HARMLESS + damaged)]
    rows += [(900, None, None), (901, "word " * 20000, None), (902, RESIDUE[0], None)]
    return spark.createDataFrame(rows, "doc_id long, text string, line_boxes array<struct<x:int,y:int,w:int,h:int,conf:int>>")


def test_found(pages):
    got = {r.doc_id for r in residue.find(pages).collect()}
    n = len(RESIDUE)
    assert set(range(n)) <= got
    assert not got & set(range(n, n + len(HARMLESS)))
    assert {n + len(HARMLESS), n + len(HARMLESS) + 1} <= got  # only through near-duplicates
    assert got & {900, 901, 902} == {902}


def test_empty(pages):
    assert residue.find(pages.limit(0)).count() == 0


def test_labels_travel_through_components(spark):
    # each step is alike to the one before it only
    base = "the image could not be loaded in the old viewer of the archive today"
    steps = [base, base.replace("today", "tonight"), base.replace("today", "tonight").replace("old ", "older "),
             base.replace("today", "tonight").replace("old ", "older ").replace("archive", "archives now")]
    rows = [(s, residue.skeleton(s), residue.simhash(s), i == 0) for i, s in enumerate(steps)]
    rows.append(("quite another sentence about herring", residue.skeleton("quite another sentence about herring"), residue.simhash("quite another"), False))
    df = spark.createDataFrame(rows, "node string, skeleton string, sim long, trusted boolean")
    from astrolith.runtime import Scratch
    known = {r.skeleton for r in residue.labelled(df, Scratch(spark, "t")).collect()}
    assert known == {r[1] for r in rows[:4]}


def test_simhash_of_damage_is_near():
    a, b = residue.simhash("please enable the viewer"), residue.simhash("plcase cnable fhe viewcr")
    assert (a ^ b).bit_count() <= residue.HAMMING


NOVEL = [
    "The reading room is closed while the shelves are counted.", "This leaf is not yet open to guests of the library.",
    "Dieses Blatt wird zur Zeit neu erfasst und fehlt daher.", "Cette feuille sera bientot de retour parmi nous.",
]
#: parts of the news, put together differently on every page
PARTS = ["Rosba", "Ella", "Tamtor", "Vervik", "Istell", "Morgo", "Quinda", "Peltor", "Hesba", "Korla"]


def news(rng, n):
    one = lambda: " ".join(rng.choice(PARTS) + rng.choice("abdegk") + rng.choice("lmnrst") for _ in range(3))
    return " ".join(f"{one()} told {one()} of {rng.randrange(9, 900)} loads near {one()} in the rain." for _ in range(n))


def test_messages_in_wordings_that_the_package_does_not_hold(spark):
    """Found by repetition and by links alone, damage and surroundings included."""
    import random

    rng = random.Random(5)
    rows, want = [], set()
    for i in range(600):
        text = news(rng, 3)
        if i % 5 == 0:
            m = NOVEL[i // 5 % len(NOVEL)]
            if i // 20 % 2:
                text = m
            else:
                if i % 3 == 0:
                    m = m.replace("e", "c", 2).replace("n", "u", 1)
                text = f"{text} {m} {news(rng, 2)}" if i % 4 == 0 else f"{text} {m}"
            want.add(i)
        rows.append((i, text, f"title {rng.randrange(12)}", None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, line_boxes array<struct<x:int,y:int,w:int,h:int,conf:int>>")
    got = {r.doc_id for r in residue.find(docs).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert got <= want


def test_nodes_of_any_length_are_hashed_whole():
    body = "abcdefghij klmno pqrst " * 4000
    a, b = residue.simhashes([body + "x" * 10, body + "the end of it all is new " * 4000])[0]
    assert len(body) > 65_535 and a != b


def test_simhash_counts_every_group():
    """Against a count group by group, across the stretches of 255."""
    import numpy as np

    for s in ("ab", "on the hill", "the quick fox " * 60):
        k = residue.skeleton(s)
        c = [int(residue._CLASS[ord(x)]) for x in f" {k} "]
        total = np.zeros(64, dtype=int)
        for table, size in ((residue._PAIRS, 2), (residue._TRIPLES, 3)):
            for i in range(len(c) - size + 1):
                code = 0
                for x in c[i : i + size]:
                    code = code * 16 + x
                total += table[code].view(np.uint8)
        n = len(c) - 1 + len(c) - 2
        want = int(sum(1 << i for i in range(64) if total[i] * 2 > n))
        got = int(residue.simhashes(["other", k, "more"])[0][1]) & (1 << 64) - 1
        assert got == want


def test_a_common_sentence_loses_its_labels(spark):
    """A trusted node whose family holds far more pages than itself labels nothing."""
    from astrolith.runtime import Scratch

    names = ["Rosba", "Ella", "Tamto", "Vervi", "Istel", "Morgo", "Quind", "Pelto", "Hesba", "Korla"]
    texts = [f"the bells of the old town were rung for # minutes when {n} came home" for n in names] + ["this page is closed while the shelves are counted"] * 1
    sims = residue.simhashes([residue.skeleton(t) for t in texts])
    rows = spark.createDataFrame([(i, int(a), int(b), t, len(t), 1) for i, (t, a, b) in enumerate(zip(texts, *sims))],
                                 "h long, sim long, fine long, node string, n int, n_pages long")
    trusted = rows.where("h in (0, 10)").select("h", "sim")
    assert {r.h for r in residue.spread(rows, rows.drop("node"), trusted, Scratch(spark, "t")).collect()} == {10}
