import time
import unicodedata

import pytest

from stratacel.llm.markup import masked, shown_text
from stratacel.llm.sentences import sentences, split_sentences


def cut(text, lang=None):
    return [text[a:b] for a, b in sentences(text, lang)]


CASES = [
    ("en", ["Dr. Bo widened it with N. U. Mel before 1971.", "It rose 205.16% in 1588, i.e. by ca. 37,599 coins."]),
    ("en", ["“It is old. It is big. It is a mill of Felo,” said Lim.", "‘Sell it!’ cried Zal, who left.", "Why was it moved?!", "(Only the quay stayed.)", "He noted: “The pier is built.”", "Most left."]),
    ("en", ["It lists a mill, a herd etc.", "It was sold by M. M. Bal Jr.", "(Only one stayed.)", "It lies at 369.69 m a.s.l.", "In 1540, it fell."]),
    ("en", ["The U.K. style house (see fig. 9.2) was flooded between 1477 and Jan. 1501.", "See www.a-b.invalid/c.html?id=67,553 for more."]),
    ("en", ["The mill is wooden... or so the keeper said.", "It was opened by Prof. Belo…", "Its ledger covers No. 8, cf. vol. 15, pp. 17–40,014."]),
    ("de", ["Am 18. März 1465 wurde sie verlegt.", "Sie liegt ca. 38,18 km (ggf. 218,68 km) nördlich von St. Bras, d. h. nahe der Burg.", "Im 13. Jahrhundert hat Dr. Felu z. B. die Warte vermessen.", "Er schrieb: „Die Mühle ist alt.“", "Das gilt usw.", "Die Bahn fährt."]),
    ("fr", ["« La halle est ouverte ! » écrit K. V. Dor en 1773.", "Vers 6 av. J.-C., elle était vendue.", "Mme Ro et MM. Pel ont trouvé la ferme, cf. p. 18…", "La gare, p. ex. à Mon, a-t-elle été vendue ?"]),
    ("es", ["¿Fue vendida antes de 1586?", "EE. UU. y Mel compraron la mina en 1838, p. ej. por 66.812 monedas.", "En la pág. 14 la Dra. Bi lo dice.", "¡Nunca fue inundada!"]),
    ("ru", ["Кто закрыл долину?! — спросил проф. Ната в 14 в.", "Население — 68255 чел. (см. рис. 11), и школа у сёл и др. мест стоит на ул. Мира, т. е. в центре.", "Она построена в 1434 г. по приказу."]),
    ("hi", ["डॉ. बारा के अनुसार क्षेत्रफल 90.57 वर्ग किमी है।", "क्या पुल कभी बनाया गया?"]),
    ("ar", ["قال د. ماكا إن الجسر يبعد 63.91 كم عن واكر.", "هل رمم الطريق في لاسا؟"]),
]


@pytest.mark.parametrize("lang,parts", CASES)
@pytest.mark.parametrize("stated", [True, False])
def test_sentences_with_blanks_between(lang, parts, stated):
    assert cut(" ".join(parts), lang if stated else "xx") == parts


@pytest.mark.parametrize("lang,parts", [c for c in CASES if c[0] in ("zh", "ja")] + [
    ("zh", ["“这座剧院很美！”德科在1497年写道。", "东部的车站是否曾被放弃？", "他说：“博物馆已经绘制。”", "1429年，它位于以北98.29公里处……附近还有学校。"]),
    ("ja", ["「この水車は美しい。」とアヒハは書いた。", "造船所（通称「リロシ。」）は駅の近くにある。", "売却されたのだろうか？", "修復された！"]),
])
def test_scripts_without_blanks(lang, parts):
    assert cut("".join(parts), lang) == parts


def test_missing_blank_or_capital_joins_nothing():
    assert cut("It was closed in 1800.He left.the next one stayed. a third followed! Done") == ["It was closed in 1800.", "He left.the next one stayed.", "a third followed!", "Done"]


def test_thai_blanks():
    first, second = "เมืองมีถนน", "วัดใหม่"
    assert cut(f"{first} {second}", "th") == [first, second]
    assert cut(f"{first}<ref>a b</ref> [[{second}]]", "th") == [f"{first}<ref>a b</ref>", f"[[{second}]]"]


def test_markup():
    text = (
        "== Head. Ing ==\n'''A''' is [[b. B|cee. Dee]].<ref>x. Y</ref> Next {{convert|1.0|km}} one<!-- z -->.\n* item one\n** [[Two]]\n# '''Three'''.\n----\n"
        "{| class=\"w\"\n! h. H\n|-\n| a. B\n|}\n{{Quote|Not. Here.}}\n[[File:a.jpg|thumb|Cap. Tion.]]\n[[Category:X]]\n<!-- end. -->\n{{Box\n| n = A. B\n}}\n...\nLast line"
    )
    assert cut(text) == ["'''A''' is [[b. B|cee. Dee]].<ref>x. Y</ref>", "Next {{convert|1.0|km}} one<!-- z -->.", "item one", "[[Two]]", "'''Three'''.", "Last line"]
    assert cut("#REDIRECT [[A. B]]") == []
    assert cut("a.''Bold'' one. ''Two'' it. ''Three.'' Four") == ["a.''Bold'' one.", "''Two'' it.", "''Three.''", "Four"]


def test_stand_ins_keep_positions():
    for text in ("", "a {{b|{{c}}}} [[d|e]] ''f'' <ref>g</ref> {{{{ [[ <!-- h", "[[File:a|b [[c]] d]] x", "<nowiki>'''''</nowiki> y", "{{{{{{\n\n}}"):
        assert len(masked(text)) == len(text)


def test_empty_null_long_and_odd_texts():
    assert sentences(None) == sentences("") == sentences(" \n\t\n") == sentences("...!?\n=\n==\n|") == []
    long = "A sentence of words. " * 20_000
    assert len(sentences(long, "en")) == 20_000
    assert len(sentences("x" * 200_000)) == 1
    assert cut("“(«unclosed. Two.") == ["“(«unclosed.", "Two."]
    assert cut("😀 One. 😀 Two.") == ["😀 One.", "😀 Two."]


@pytest.mark.parametrize("blanks", [1, 3, 25, 3000])
def test_rules_look_past_any_number_of_blanks(blanks):
    gap = " " * blanks
    assert len(cut(f"It holds five etc.{gap}and more", "en")) == 1
    assert len(cut(f"Am 18.{gap}Jahrhundert", "de")) == 1
    assert len(cut(f"Prof.{gap}Dr. Bo", "en")) == 1
    assert len(cut(f"It is old.{gap}It is big.", "en")) == 2
    assert len(cut(f"Zal cried: “Sell it!”{gap}— and left.", "en")) == 1


def test_accents_as_characters_of_their_own():
    parts = ["En la pág. 14 la Dra. Bi lo dice, núm. 15.", "La halle était déjà restaurée.", "Sa digue couvre la place.", "Am 5. März 1446 war É. B. Pel da."]
    text = unicodedata.normalize("NFD", " ".join(parts))
    assert cut(text) == [unicodedata.normalize("NFD", p) for p in parts]


ODD_LINES = {
    "plain": "A sentence of words. " * 50_000, "unclosed quotations": "“It is. " * 60_000, "nested brackets": "(One. " * 30_000 + ")" * 30_000,
    "crossed brackets": "(a. [b. " * 30_000 + ")" * 30_000, "apostrophes": "(" * 30_000 + "‘don’t " * 30_000, "initials": "A.B." * 30_000,
    "one label": "[[a|" + "One. Two. " * 50_000 + "]]", "link at the end": "One. Two. " * 30_000 + "[[a]]", "addresses": "x" * 500_000 + " @/", "blanks": "a." + " " * 500_000 + "b",
    "closers": ".)" * 100_000, "dotted": "a." * 200_000 + "/", "figures": "1. " * 30_000,
}


@pytest.mark.parametrize("name", ODD_LINES)
def test_long_lines_take_linear_time(name):
    began = time.process_time()
    sentences(ODD_LINES[name], "en")
    assert time.process_time() - began < 3  # quadratic work would take minutes


@pytest.mark.parametrize("piece,end", [("<!-- a ", ""), ("<ref>a ", ""), ("{{a ", ""), ("{{a ", "}}"), ("[[a|b ", ""), ("[[a ", "]]"), ("<nowiki>", ""), ("\n{| a", ""), ("[//", ""), ("{{[[<!-- <ref ", "")])
def test_unclosed_and_deep_markup_takes_linear_time(piece, end):
    text = piece * 16_000 + end * 16_000
    began = time.process_time()
    assert len(masked(text)) == len(text)
    shown_text(text)
    assert time.process_time() - began < 1


def test_nested_markup():
    assert shown_text("a{{b|{{c}}|{{{d}}}}}e{{f") == "ae{{f"
    assert shown_text("[[File:a.jpg|thumb|b [[c|d]] e]]f [[g|h]] [[i]] [[j k") == " f h i [[j k"
    assert shown_text("a<ref>b</ref>c<ref name=x/>d<!-- e -->f<ref>g\nh<!-- i\nj") == "acdf\nh\nj"
    assert masked("{{a}}b{{{c}}") == masked("{{x}}")[:1] * 5 + "b{" + masked("{{x}}")[:1] * 5


def test_operator(spark):
    rows = [(1, "One. Two.", "en", 0), (2, None, None, 0), (3, "", "de", 0), (None, "Alone", "xx", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, key int")
    out = {tuple(r) for r in split_sentences(df).collect()}
    assert out == {(1, 0, 4), (1, 5, 9), (None, 0, 5)}
    assert split_sentences(df.limit(0)).count() == 0
