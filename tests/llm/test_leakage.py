"""Leaks of evaluation items, against quotations of known length."""

import random

import pytest

from astrolith.llm import leakage, pages

TEMPLATE = ("{a} stacked {n1} oak wedges beside the old dye shed and gave {n2} of them to {b} . On the way from {p} to {q} "
            "{b} lost {n3} paper lanterns every {n4} miles . How many lanterns does {a} still own after {n5} days and why did {b} leave {p} before noon")
NAMES = [f"{a}{b} {c}{d}" for a, b, c, d in zip(
    ["Bra", "Tam", "Pel", "Kor", "El", "Hes"] * 5, ["so", "te", "ma", "va", "ri"] * 6,
    ["Ros", "Ist", "Ul", "Nev", "Ver", "Dor", "Gal"] * 5, ["gonor", "fihurst", "goik", "balen"] * 8)]
TOWNS = ["Morlen", "Istton", "Galbach", "Wenvik", "Ulfield"]


def make(rng):
    a, b = rng.sample(NAMES, 2)
    p, q = rng.sample(TOWNS, 2)
    return TEMPLATE.format(a=a, b=b, p=p, q=q, **{f"n{i}": rng.randrange(20, 990) for i in range(1, 6)})


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    rows = [(i, make(rng)) for i in range(1, 13)]
    return rows, leakage.Items(rows)


FILLER = "The water rose by 22 inches in one night and reached the cellar of Lamri Quinpaik . It is reported that 87 houses stand empty . "


def words_of(text):
    return [w for w in text.split() if w != "."]


@pytest.mark.parametrize("n,leak", [(15, True), (22, True), (14, False), (9, False)])
def test_length_decides(data, n, leak):
    rows, items = data
    for start in (0, 7, 20):
        quote = " ".join(words_of(rows[3][1])[start : start + n])
        assert (rows[3][0] in items.leaks(FILLER + quote + " . " + FILLER)) == leak


def test_other_slot_values_are_no_leak(data):
    rows, items = data
    other = rows[3][1]
    for w in {w for w in words_of(other) if w[0].isupper() or w.isdigit()} - {"On", "How"}:
        other = other.replace(w, str(1370 + len(w)) if w.isdigit() else w[::-1].title())
    assert items.leaks(FILLER + other + FILLER) == []


def test_damage_breaks_and_adverts(data):
    rows, items = data
    w = words_of(rows[5][1])
    text = " ".join(w).replace("stacked", "ftackecl").replace("lanterns", "lan=\nterns").replace("every", "cvery").replace("the old", "theold")
    lines = text.split(" lost ")
    page = FILLER.replace(" . ", "\n") + "\n" + lines[0] + "\nLOST, a grey dog, 19 June. Reward 23 crowns.\n" + "lost " + lines[1]
    assert items.leaks(page.upper()) == items.leaks(page) == [rows[5][0]]


def test_two_columns_read_across(data):
    rows, items = data
    w = words_of(rows[7][1])
    left = [" ".join(w[i : i + 4]) for i in range(0, len(w), 4)]
    right = [" ".join(words_of(FILLER * 3)[i : i + 4]) for i in range(0, 4 * len(left), 4)]
    lines, xs = [], []
    for a, b in zip(left, right):
        lines += [a, b]
        xs += [40, 420]
    assert items.leaks("\n".join(lines), xs, [300] * len(xs)) == [rows[7][0]]


def test_reading_order_without_boxes():
    assert pages.reading_order("a\r\nb", None, None) == ["a", "b"]
    assert pages.joined(["acc-", "ourues", "un¬", "til 3-", "4"]) == "accourues\nuntil 3-\n4"


def test_frames(spark, data):
    rows, _ = data
    box = [{"x": 1, "y": 1, "w": 9, "h": 9, "conf": 9}]
    schema = "doc_id long, text string, line_boxes array<struct<x:int,y:int,w:int,h:int,conf:int>>, item_id long"
    docs = spark.createDataFrame(
        [(1, rows[0][1], box, 0), (2, None, None, 0), (3, "", [], 0), (4, " ", box, 0), (5, rows[0][1] + " " + rows[1][1], None, 0),
         (6, FILLER * 2000, None, 0)], schema)
    items = spark.createDataFrame([*rows, (90, None), (91, ""), (92, "too short")], "item_id long, text string")
    got = {tuple(r) for r in leakage.find(docs, items).collect()}
    assert got == {(1, 1), (5, 1), (5, 2)}
    assert leakage.find(docs.limit(0), items).count() == 0
    assert leakage.find(docs, items.limit(0)).count() == 0


def test_long_page_of_many_items(data):
    rows, items = data
    page = (" . ".join(t for _, t in rows) + " . ") * 12
    assert items.leaks(page) == [i for i, _ in rows]


def test_every_undamaged_passage_with_few_slots():
    """One number and one name, or none, in the fifteen words."""
    texts = [
        "no one in {p} may carry more than {n} clay marbles through the weighing hall without a written pass from the old warden of {q} and {a}",
        "we were told that after the long rain had ended all of the small boats were drawn up on the sand beside the mill of {a} in {q}",
    ]
    rng = random.Random(11)
    rows = [(i, texts[i % 2].format(a=rng.choice(NAMES), p=rng.choice(TOWNS), q=rng.choice(TOWNS), n=rng.randrange(100, 990))) for i in range(24)]
    items = leakage.Items(rows)
    for i, text in rows:
        w = text.split()
        for start in range(len(w) - 14):
            assert i in items.leaks(FILLER + " ".join(w[start : start + 15]) + " . " + FILLER), (i, start)


def test_slot_check_drops_nothing_that_the_comparison_accepts():
    rng = random.Random(12)
    for _ in range(300):
        items = leakage.Items([])
        n = rng.randrange(15, 60)
        words = [f"w{i}" for i in range(n)]
        items.words, items.slots = [words], [[rng.random() < 0.3 for _ in range(n)]]
        items.slot_words = [{w for w, s in zip(words, items.slots[0]) if s}]
        page = [w if rng.random() < 0.8 else w[::-1] for w in words]
        if leakage.longest_run(words, items.slots[0], page) >= 15:
            assert items.possible(0, set(page))


def test_other_numbers_and_one_town_are_no_leak(data):
    """Every number with another last digit, one town replaced: at most eleven words on end are the item's own."""
    rows, items = data
    for i, text in rows:
        other = " ".join(w[:-1] + str((int(w[-1]) + 3) % 10) if w.isdigit() else w for w in text.split())
        town = next(w for w in text.split() if w in TOWNS)
        other = other.replace(town, next(t for t in TOWNS if t not in text))
        assert items.leaks(FILLER + other + FILLER) == [], i


def test_plain_item_without_names_or_numbers():
    text = ("when the long rain was over all of the small boats were drawn up on the wet sand beside the "
            "old mill and nobody knew who had brought them there")
    items = leakage.Items([(1, text), (2, text.replace("boats", "wagons").replace("sand", "gravel"))])
    assert items.leaks(FILLER + text + FILLER) == [1]


def test_result_is_the_same_for_any_number_of_items(spark, data):
    rows, _ = data
    rng = random.Random(8)
    words = ["alder", "beech", "cedar", "lime", "maple", "oak", "pine", "rowan", "willow", "yew"]
    many = [(1000 + i, " ".join(rng.choice(words) + rng.choice("abcdef") for _ in range(20)) + f" {make(rng)}") for i in range(6_000)]
    docs = spark.createDataFrame([(1, FILLER + rows[3][1], None), (2, " ".join(words_of(rows[5][1])[4:21]), None), (3, FILLER, None)],
                                 "doc_id long, text string, line_boxes array<struct<x:int,y:int,w:int,h:int,conf:int>>")
    frame = lambda x: spark.createDataFrame(x, "item_id long, text string")
    few = {tuple(r) for r in leakage.find(docs, frame(rows)).collect()}
    assert few == {(1, rows[3][0]), (2, rows[5][0])}
    assert {tuple(r) for r in leakage.find(docs, frame(rows + many)).collect() if r.item_id < 1000} == few


def test_join_finds_what_one_page_at_a_time_finds(spark, data):
    rows, items = data
    rng = random.Random(9)
    texts = []
    for i in range(40):
        w = words_of(rng.choice(rows)[1])
        a = rng.randrange(0, len(w) - 12)
        part = [x if rng.random() < 0.9 else x.replace("e", "c").replace("n", "u") for x in w[a : a + rng.randrange(10, 30)]]
        texts.append((i, FILLER + " ".join(part) + " . " + FILLER, None))
    docs = spark.createDataFrame(texts, "doc_id long, text string, line_boxes array<struct<x:int,y:int,w:int,h:int,conf:int>>")
    got = {tuple(r) for r in leakage.find(docs, spark.createDataFrame(rows, "item_id long, text string")).collect()}
    assert got == {(d, k) for d, t, _ in texts for k in items.leaks(t)} != set()
