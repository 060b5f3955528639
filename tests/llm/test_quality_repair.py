import random

import pytest
from platlens.llm import quality
from platlens.llm.quality import CONTEXT, Measure, is_sentence, loose_letters, merge, statistics, text_quality
from platlens.llm.scan_repair import Repair, ScanModel, explain, fit, head_form, repaired, strokes

COMMON = frozenset("the of and to in a we will for is our".split())
PROSE = "We will repair the roads in our town. The board is to build a school for the children of the north. " * 3


def kind(text):
    return statistics(Measure(COMMON)(text), len(text), 0.5)[-1]


@pytest.mark.parametrize(
    ("text", "prose"),
    [
        (PROSE, True),
        (PROSE.replace(" of ", "\nof "), True),
        ("We will do the following in our town.\n" + "\n".join(f"- item number {w}" for w in "abcdefghij"), False),
        ("\n".join(f"Town {i}\t{i * 7}\t{i}.5%" for i in range(20)), False),
        ("The list is here.\n" + "river dredging; bike lanes; jury pay; tax bills; rail " * 8, False),
        ("xQ8z+/AbC93kd" * 40, False),
        ("daor eht fo dne ehT .nwot ruo ni sdaor eht riaper lliw eW " * 5, False),
        (PROSE + "\n- one item\n- two items", True),
        ("我们将守护河流。社区委员会计划修复旧桥，让每个家庭受益。" * 3, True),
        ("हमारी टीम नदी को बचाएगी। नई सरकार सड़क ठीक करेगी। " * 4, True),
    ],
)
def test_kinds(text, prose):
    assert kind(text) is prose


def test_fragments():
    assert is_sentence([6, 25, 2, 0, 0, 0, 0, 0]) and not is_sentence([6, 25, 0, 0, 0, 0, 0, 0]) and not is_sentence([1, 5, 1, 0, 0, 0, 0, 0])


def in_pieces(m, text, size):
    parts = []
    for i in range(0, len(text), size):
        lead = min(i, CONTEXT)
        parts.append(m(text[i - lead : i + size + CONTEXT], lead, size, i + size >= len(text)))
    while len(parts) > 1:  # as a tree
        parts = [merge(*parts[i : i + 2]) if len(parts[i : i + 2]) == 2 else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


@pytest.mark.parametrize("size", [40, 97, 333, 1000, 4096, 65_536])
@pytest.mark.parametrize("seed", range(5))
def test_pieces_add_up_to_the_whole(size, seed):
    r = random.Random(size * 100 + seed)
    words = [*sorted(COMMON), "estrada", "ação", "x9", "3.5", "हिन्दी", "e\u0301", "longword" * 3, "１２", "----", "Ã©"]
    gaps = [" ", " ", " ", ". ", ".\n", "\n- ", "; ", "!? ", "  ", "\n", "\n      12.3 ", "\t", "。", " ... "]
    plain = [" "] * 8 + ["\n", ". "]
    m = Measure(COMMON)
    for j in range(20 if size < 4096 else 3):
        text = ""
        for _ in range(r.randint(1, max(200, size // 3))):
            text += r.choice(words) + r.choice(gaps if j % 2 else plain)
        whole, part = m(text), in_pieces(m, text, size)
        assert part[:4] == whole[:4] and loose_letters(part[4]) == loose_letters(whole[4])
        assert statistics(part, len(text), 0.5) == statistics(whole, len(text), 0.5)


def test_table(spark):
    rows = [(1, PROSE, "a"), (2, None, "b"), (3, "", "c"), (4, " \n ", "d"), (5, PROSE * 30, "e"), (5, PROSE * 30, "e"), (1, PROSE, "z")]
    common = spark.createDataFrame([("en", w) for w in COMMON] + [("en", None)], "lang string, word string")
    df = spark.createDataFrame(rows, "doc_id bigint, text string, words string")
    out = text_quality(df, common, piece=500).collect()
    by = {r.doc_id: r for r in out}
    assert by[2].is_prose is None and by[3].words == 0 and by[4].is_prose is None and by[1].is_prose
    assert by[5].words == 30 * by[1].words and by[5].sentences == 30 * by[1].sentences and by[5].chars == len(PROSE) * 30
    assert sum(r.doc_id == 1 for r in out) == 2 and sum(r.doc_id == 5 for r in out) == 2
    assert text_quality(df.limit(0), common).count() == 0
    assert text_quality(df, common.limit(0)).count() >= 6
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality, "MOST_COMMON", 3)
        with pytest.raises(ValueError):
            text_quality(df, common)
    s = text_quality(df.selectExpr("cast(doc_id as string) doc_id", "text"), common, piece=500)
    assert s.where("doc_id = '5'").first().words == by[5].words


@pytest.mark.parametrize(("right", "seen"), [("governo", "govemo"), ("visitaram", "vi5itaram"), ("poder", "pocler"), ("finalmente", "fmalrnerite"), ("partir", "parür"), ("segurança", "segiirança"), ("bairro", "b@irro"), ("minha", "rninlia")])
def test_confusions(right, seen):
    assert strokes(right) == strokes(seen) and explain(right, seen)


def test_no_confusion():
    assert explain("rua", "lua") is None and explain("rua", "rua") == 0


def model(place="Serra Nova"):
    words = "a prefeitura vai ampliar o conselho de saúde em parceria com as famílias e bem vindos mutirões pré natal governo".split()
    counts = dict.fromkeys(words, 100) | {"govemo": 3}
    return ScanModel(counts, frozenset(["bem-vindos", "pré-natal"]), frozenset([head_form(f"Plano de Governo / {place}", place)]))


@pytest.mark.parametrize(
    ("text", "fixed", "kinds"),
    [
        ("A prefeitura vai ampliar\no conselho", "A prefeitura vai ampliar\no conselho", []),
        ("A prefei-\ntura vai", "A prefeitura vai", ["hyphenation"]),
        ("os bem-\nvindos mutirões", "os bem-\nvindos mutirões", []),
        ("em parce- ria com", "em parceria com", ["hyphenation"]),
        ("em parx- zria com", "em parx- zria com", []),
        ("em parc- cria com", "em parceria com", ["hyphenation", "misread"]),
        ("em parc- eria com o gov3mo", "em parceria com o gov3mo", ["hyphenation"]),
        ("A preFeitura\nPlano de Govcrno / Serra Nova - 12\nvai ampliar", "A preFeitura vai ampliar", ["misread", "page_number", "running_header"]),
        ("A saúde\n[14]\nvai", "A saúde vai", ["page_number"]),
        ("O c0nselho de saúdc", "O conselho de saúde", ["misread"]),
        ("", "", []),
    ],
)
def test_repairs(text, fixed, kinds):
    assert Repair(model())(text, "Serra Nova") == (fixed, kinds)


def test_collection(spark):
    r = random.Random(3)
    nouns = "creches escolas praças pontes estradas ruas".split()
    clean = [f"A prefeitura vai ampliar as {r.choice(nouns)} e as {r.choice(nouns)} com apoio da comunidade" for _ in range(600)]
    rows = [(f"d{i // 10}#s{i % 10}", f"d{i // 10}", t, "Alto Lago", 1) for i, t in enumerate(clean)]
    for i in range(0, 600, 10):
        k, d, t, p, n = rows[i]
        rows[i] = (k, d, t.replace(" vai", "\nCandidatura 12345 / Alto Lago\nvai", 1).replace("ampliar", "arnp1iar"), p, n)
    rows += [("n#s0", "n", None, "Alto Lago", 1), ("e#s0", "e", "", None, 1), ("l#s0", "l", "palavra " * 50_000, None, 1), rows[0]]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, chunk_text string, municipality_name string, kinds int")
    out = {r.chunk_id: r for r in repaired(df, fit(df)).collect()}
    assert "n#s0" not in out and out["e#s0"].kinds == [] and out["l#s0"].word_count == 50_000
    for i in range(600):
        x = out[rows[i][0]]
        assert x.chunk_text == clean[i] and x.kinds == (["misread", "running_header"] if i % 10 == 0 else []), x
    empty = df.limit(0)
    assert repaired(empty, fit(empty)).count() == 0


def test_rare_words_are_known_in_a_large_collection(spark):
    rows = [(f"f{i}", "f", "palavra " * 50_000) for i in range(120)] + [(f"r{i}", "r", "uma passarela bem-estar") for i in range(9)]
    rows += [("m", "m", "uma passare1a"), ("h", "h", "todo o bem-\nestar")]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, chunk_text string").repartition(8)
    model = fit(df, place=None)
    assert model.words["passarela"] == 9 and "bem-estar" in model.compounds
    few = df.where("chunk_id in ('m', 'h')")
    out = {r.chunk_id: r for r in repaired(few, model, place=None).collect()}
    assert out["m"].chunk_text == "uma passarela" and out["m"].kinds == ["misread"] and out["h"].kinds == []
