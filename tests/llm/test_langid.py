"""Language of spans: held-out sentences per language, code, spellings."""

import pytest

from astrolith.llm import langid

HELD_OUT = {
    "en": ["The key does not fit into the lock of the garden door", "You have to wait until the other user has left"],
    "de": ["Der Schlüssel passt nicht in das Schloss der Tür", "Bitte warten Sie, bis der andere Benutzer fertig ist"],
    "fr": ["La clé ne va pas dans la serrure de la porte", "Vous devez attendre que l'autre utilisateur soit parti"],
    "es": ["La llave no entra en la puerta del jardín", "Debe esperar hasta que el otro usuario haya terminado"],
    "it": ["La chiave non entra nella porta del giardino", "Bisogna aspettare che l'altro utente abbia finito"],
    "pt": ["A chave não entra na porta do jardim", "Você deve esperar até que o outro usuário tenha acabado"],
    "nl": ["De sleutel past niet in de deur van het huis", "U moet wachten tot de andere gebruiker klaar is"],
    "sv": ["Nyckeln passar inte i dörren till huset", "Du måste vänta tills den andra har gått"],
    "pl": ["Klucz nie pasuje do drzwi tego domu", "Musisz poczekać, aż inny program skończy"],
    "ru": ["Ключ не подходит к двери этого дома", "Нужно подождать, пока другой пользователь закончит"],
    "zh": ["钥匙打不开花园的门", "请等待其他用户完成之后再试一次"],
    "ja": ["鍵が庭の戸に合いません", "ほかの人が終わるまでお待ちください"],
}
CODE = ["for (int i = 0; i < n; ++i) { total += list[i]; }", "SELECT a, b FROM t WHERE id = ?", "red green blue alpha", "a/b/c/d.txt",
        "one,two,three,four,five", "net.core.size max_ms io.count ui.name", "kg m s A K mol cd", "Cancel", "", "   ", None, "%d %s %f %x"]


@pytest.fixture(scope="module")
def me():
    return langid.Identifier()


def test_held_out_languages(me):
    got = [(lang, s, me.text(s)) for lang, texts in HELD_OUT.items() for s in texts]
    wrong = [g for g in got if not g[2] or g[2][0] != g[0]]
    assert len(wrong) <= 2, wrong


@pytest.mark.parametrize("text", CODE)
def test_code_is_rejected(me, text):
    assert me.text(text) is None


def test_spellings(me):
    s = HELD_OUT["de"][0]
    assert me.text(s.encode().decode("latin-1").encode("latin-1").decode().replace("ü", "\\xc3\\xbc"))[0] == "de"
    assert me.text(s.replace("ü", "\\303\\274"))[0] == "de"
    assert me.text(s.replace("ü", "\\u00fc"))[0] == "de"
    assert me.text(s.upper())[0] == "de"
    assert me.text(s[:12] + '"\\n\\t"' + s[12:])[0] == "de"
    assert me.text(f"<p class='x'>{s}</p>")[0] == "de"
    assert me.text(f"int a = b; // {s}\\n")[0] == "de"


def test_column(spark):
    rows = [(1, HELD_OUT["fr"][1]), (2, None), (3, ""), (4, "x_y_z"), (5, HELD_OUT["fr"][1].upper()), (6, "word " * 4000)]
    df = spark.createDataFrame(rows, "id long, content string")
    assert {(r.id, r.lang) for r in langid.identify(df).collect()} >= {(1, "fr"), (5, "fr")}
    assert langid.identify(df.limit(0)).count() == 0


def test_short_clauses_of_chinese_give_spans():
    assert langid.spans("文件未找到") == ["文件未找到"] and langid.spans("保存失败") == ["保存失败"]


def test_share_counts_both_sides_in_what_the_spelling_stands_for(spark):
    plain = "Vous devez attendre la fin de la copie"
    escaped = "".join(f"\\x{b:02x}" for b in plain.encode())
    df = spark.createDataFrame([(1, plain, 7), (2, escaped, 8), (3, None, 9), (4, "", 9)], "id long, content string, file_id long")
    got = {r.file_id: (r.lang, r.n_natural, r.n_chars) for r in langid.measure(df, keep=("file_id",), more={}).collect()}
    assert got[7] == got[8] == ("fr", len(plain), len(plain)) and 9 not in got
