import random

import pytest
from platlens.llm import sentences as module
from platlens.llm.sentences import Splitter, fit, fit_on, sentence_ends, sentences


def corpus():
    """Texts of known sentences, so that accuracy can be held against what they were made of."""
    r = random.Random(4)
    starts, ends = ["The board", "Our team", "We", "Nurses", "Every town"], ["the bridge", "the schools", "two roads", "clean water", "the plan"]
    made = []
    for _ in range(1500):
        own = []
        for _ in range(r.randint(1, 4)):
            k = r.random()
            if k < 0.2:
                own.append(f"Dr. {r.choice(['Moreno', 'Silva', 'Weber'])} and Mrs. {r.choice(['Lind', 'Costa'])} saw {r.choice(ends)}.")
            elif k < 0.3:
                own.append(f"It cost {r.randint(1, 9)}.{r.randint(0, 9)} million, i.e. more than planned.")
            elif k < 0.4:
                own.append(f"“{r.choice(starts)} will wait!” read the sign.")
            else:
                own.append(f"{r.choice(starts)} will repair {r.choice(ends)}{r.choice('.!?')}")
        made.append(own)
    return made


@pytest.fixture(scope="module")
def splitter():
    return Splitter(fit(" ".join(s) for s in corpus()))


def ends_of(own):
    out, at = [], 0
    for s in own:
        at += len(s)
        out.append(at)
        at += 1
    return out


def test_held_out_accuracy():
    made = corpus()
    sp = Splitter(fit(" ".join(s) for s in made[:1000]))
    right = sum(sp.ends(" ".join(s)) == ends_of(s) for s in made[1000:])
    assert right >= 0.98 * len(made[1000:])


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("我们守护河流。新的团队修桥！真的吗？", ["我们守护河流。", "新的团队修桥！", "真的吗？"]),
        ("यह नदी है। नई सरकार आएगी।", ["यह नदी है।", "नई सरकार आएगी।"]),
        ("Costs rose ... and nobody noticed. We did.", ["Costs rose ... and nobody noticed.", "We did."]),
        ("We repair roads.Our team builds.", ["We repair roads.", "Our team builds."]),
        ("II. The board met. 3. We went home", ["II. The board met.", "3. We went home"]),
        ("(Yes, even here.) The board met.", ["(Yes, even here.)", "The board met."]),
        ('"Enough is enough. We want roads," said the board. We left.', ['"Enough is enough. We want roads," said the board.', "We left."]),
        ("He paid 3.5 million; she said: no. The board met", ["He paid 3.5 million; she said: no.", "The board met"]),
        ("Stop!!! The board met. —", ["Stop!!!", "The board met. —"]),
    ],
)
def test_single_rules(splitter, text, parts):
    ends = splitter.ends(text)
    got = [text[a:b].strip() for a, b in zip([0, *ends], ends)]
    assert got == parts


def test_nothing_to_split(splitter):
    assert splitter.ends("") == [] and splitter.ends(" ... !") == [] and splitter.ends("no stop at all ") == [14]
    assert len(splitter.ends("The board met. " * 50_000)) == 50_000


def test_tables(spark):
    rows = [("a", "The board met. We left.", 1), ("a", "The board met. We left.", 1), ("b", None, 2), ("c", "", 3), ("d", "One line\nof two. Next.\n\nNew block", 4)]
    df = spark.createDataFrame(rows, "chunk_id string, chunk_text string, ends int")
    model = fit_on(df)
    out = sentence_ends(df, model, ["chunk_id"]).collect()
    assert len(out) == 5 and {r.chunk_id: r.ends for r in out}["b"] == []
    s = sentences(df.distinct(), model).where("chunk_id = 'd'").orderBy("sentence_no").collect()
    assert [r.sentence for r in s] == ["One line\nof two.", "Next.", "New block"]
    assert [r.start_char for r in s][0] == 0 and s[-1].end_char == len(rows[-1][1])
    empty = df.limit(0)
    assert sentence_ends(empty, fit_on(empty), ["chunk_id"]).count() == 0


def test_types_are_counted_over_all_texts(spark):
    texts = sorted({" ".join(s) for s in corpus()}) + [f"Our team saw Xqz. Moreno at bridge {k} today." for k in range(12)]
    df = spark.createDataFrame([(t,) for t in [*texts, *texts[:50], None]], "chunk_text string")
    whole, model = fit(texts), fit_on(df, sample=20)
    assert model.ends == whole.ends and model.starts == whole.starts and model.ends["Xqz"] < -1


@pytest.mark.parametrize("extra", [[("a\nb",)] * 900, [("The same text.",)] * 900])
def test_sample_is_filled_with_different_texts(spark, monkeypatch, extra):
    seen, spots = [], module._spots
    monkeypatch.setattr(module, "_spots", lambda texts: seen.extend(r.t for r in texts.collect()) or spots(texts))
    fit_on(spark.createDataFrame([(f"Text {k} is here.",) for k in range(100)] + extra, "chunk_text string"), sample=90)
    assert len(seen) == len(set(seen)) == 90


def test_many_quotations_take_linear_time(splitter):
    from time import perf_counter

    def seconds(n):
        text = "He said: “Stop. Go on,” and left. (Then it. rained “on “ and ‘on. " * n
        began = perf_counter()
        ends = splitter.ends(text)
        assert ends[-1] == len(text.rstrip())
        return perf_counter() - began

    seconds(200)
    assert seconds(8000) < 12 * seconds(1000) + 0.5
