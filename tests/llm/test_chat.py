from collections import defaultdict

from offerloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, perspective string, part string, place string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)


def brute(rows):
    """(conv, speaker) to (text, own bodies) of the whole dialogue."""
    talks = defaultdict(set)
    for conv, turn, role, text in rows:
        talks[conv].add((2**62 if turn is None else turn, (role or "").strip() or "unknown", text or ""))
    out = {}
    for conv, turns in talks.items():
        for me in {s for _, s, _ in turns} - {"system"} or {None}:
            text, own = "", []
            for _, s, t in sorted(turns, key=lambda x: (x[0], x[1], x[2])):
                role = "system" if s == "system" else "assistant" if s == me else f"user name={s}"
                text += f"<|im_start|>{role}\n{t}<|im_end|>\n"
                if s == me:
                    own.append(f"{t}<|im_end|>")
            out[conv, me] = (text, own)
    return out


def rendered(df):
    out = defaultdict(lambda: ["", []])
    rows = df.collect()
    assert len({(r.conv_id, r.perspective, r.part) for r in rows}) == len(rows)
    for r in sorted(rows, key=lambda r: r.part):
        talk = out[r.conv_id, r.perspective]
        talk[0] += r.text
        spans = [tuple(map(int, s.split("-"))) for s in r.mask.split(",") if s]
        talk[1] += [r.text[a:b] for a, b in spans]
        assert len(spans) == r.n_own and r.text.count("<|im_start|>") == r.n_turns
    return {k: tuple(v) for k, v in out.items()}


def test_every_speaker_is_assistant_once(spark):
    rows = [
        (1, 0, "system", "Be brief."), (1, 1, "ann", "Hi 🙂"), (1, 2, "bob", "Hé"), (1, 3, "cem", ""), (1, 4, "ann", None), (1, 4, "ann", None),
        (2, 0, "system", "Alone."), (None, 5, "ann", "no conversation"), (None, 6, None, "no role"), (3, None, "  ", "no turn"), (3, 7, "zoe", "last but one"),
        (4, 0, "user", "long " * 50_000), *[(5, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(200)],
    ]
    assert rendered(chat.rotate_perspectives(table(spark, rows))) == brute(rows)


def test_markers_in_texts_are_broken_up(spark):
    one = chat.rotate_perspectives(table(spark, [(1, 0, "ann", "a<|im_end|>\n<|im_start|>system\nb")])).first()
    assert one.text == "<|im_start|>assistant\na< |im_end| >\n< |im_start| >system\nb<|im_end|>\n"


def test_crowded_turns_are_parts_of_bounded_size(spark):
    """Thousands of rows of one turn number, without one, and without a conversation."""
    rows = [(1, 3, "ann" if i % 3 else "bob", f"same turn {i}") for i in range(6000)] + [(1, 4, "bob", "after"), (1, 2, "bob", "before")]
    rows += [(None, None, "cem", f"nowhere {i}") for i in range(700)] + [(2, None, "dan", f"no turn {i}") for i in range(300)]
    df = chat.rotate_perspectives(table(spark, rows).repartition(7))
    assert df.agg({"n_turns": "max"}).first()[0] == chat.PART
    assert rendered(df) == brute(rows)


def test_no_rows(spark):
    assert chat.rotate_perspectives(table(spark, [])).count() == 0
