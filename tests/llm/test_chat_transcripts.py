import random

import numpy as np
import pytest

from loamstack.llm import chat_transcripts as C


def path_score(m, features, states):
    seen = m.seen(features)
    total = m.start[states[0]] + seen[0][states[0]]
    for i in range(1, len(states)):
        total += m.step[states[i - 1], states[i]] + seen[i][states[i]]
    return total


def test_segments_trace_the_best_path():
    rng = random.Random(4)
    m = C.RoleModel.prior()
    for _ in range(20):
        lines = [rng.choice(["User: hi?", "AI: yes", "and so on", "", "System: be", "Note: x" * 30]) for _ in range(6)]
        features = C.observed(lines, True)
        import itertools

        best = max(path_score(m, features, s) for s in itertools.product(range(C.STATES), repeat=6) if np.isfinite(path_score(m, features, s)))
        whole = m.trace(features, None, None)
        assert np.isclose(path_score(m, features, whole), best)
        parts = [features[:2], features[2:3], features[3:]]
        ends = C.cuts([m.reduce(p, i == 0) for i, p in enumerate(parts)])
        states = [s for i, p in enumerate(parts) for s in m.trace(p, ends[i - 1] if i else None, ends[i])]
        assert np.isclose(path_score(m, features, states), best)


def test_markers():
    assert C.marker("User: hello") == (2, 6)
    assert C.marker("**Assistant**: hello")[0] == 3
    assert C.marker("[system] hello")[0] == 1
    assert C.marker("Note: hello")[0] == 4
    assert C.marker("plain text")[0] == 0 and C.marker("")[0] == 0


def test_roles_of_held_out_conversations(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    lines = C.segments(C.plain_transcripts(table))
    model = C.fit(lines.where(C.fold(5, "id") != 0))
    right = total = 0
    truth, got = {}, {}
    for r in lines.where(C.fold(5, "id") == 0).orderBy("id", "seg").collect():
        truth.setdefault(r.id, []).extend(r.states)
    for r in C.parse(lines.where(C.fold(5, "id") == 0), model).orderBy("id", "turn_no").collect():
        got.setdefault(r.id, []).extend(r.line_states)
    for i, states in truth.items():
        assert len(states) == len(got[i])
        right += sum(a // 2 == b // 2 for a, b in zip(states, got[i]))
        total += len(states)
    assert right / total > 0.95


def brute(rows, model):
    """Turns of one transcript as a whole: rows (place, text) in order, one trace, one rendering."""
    lines = [x for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")) for x in (t or "").split("\n")]
    states = model.trace(C.observed(lines, True), None, None)
    turns = []
    for line, s in zip(lines, states):
        if s % 2 == 0:
            own = C.ROLES[C.marker(line)[0] - 1] == C.ROLES[s // 2] if 1 <= C.marker(line)[0] <= 3 else False
            turns.append((C.ROLES[s // 2], [line[C.marker(line)[1] :] if own else line]))
        else:
            turns[-1][1].append(line)
    return [(k, r, len(t), f"<|{r}|>\n" + "\n".join(t).strip("\n") + "\n<|end|>\n") for k, (r, t) in enumerate(turns)]


def test_any_cut_gives_what_the_whole_gives(spark):
    rng = random.Random(6)
    some = ["User: hi?", "AI: yes", "and so on", "", "", "System: be", "Note: x" * 30, "plain", "Q: why\n\nbecause\n\n", "A: so\nit is", None]
    rows = [(c, p if p % 7 else None, rng.choice(some)) for c in (1, 2, None, 4, 5) for p in range(rng.randrange(1, 60))]
    rows += [(9, 0, "User: " + "\n".join(f"line {k}" for k in range(600))), (9, 1, "AI: short"), (10, -3, "x"), (11, None, "")] + [(12, 5, "same")] * 9
    table = spark.createDataFrame([(*r, rng.choice([*C.ROLES, None])) for r in rows], "id long, place long, text string, role string")
    by = {}
    for i, p, t in rows:
        by.setdefault(i, []).append((p, t))
    seen = []
    for segment, fan in ((1, 2), (4, 3), (256, 256), (1 << 20, 256)):
        lines = C.segments(table, segment)
        assert lines.where(C.F.size("lines") > segment).count() == 0
        model = C.fit(lines)
        seen.append([x.tobytes() for x in (model.start, model.step, *model.emit)])
        got = {}
        for r in C.parse(lines, model, fan).collect():
            got.setdefault(r.id, []).append((r.turn_no, r.role, len(r.line_states), r.rendered))
        assert {i: sorted(x) for i, x in got.items()} == {i: brute(x, model) for i, x in by.items()}
    assert all(x == seen[0] for x in seen)
    assert got[9][0][2] >= 600


def test_edges(spark):
    schema = "conv_id long, turn int, role string, text string, seg int, id string"
    rows = [(1, 0, "user", None, 9, "i"), (1, 1, None, "x", 9, "i"), (None, 0, "user", "Q", 9, "i"), (None, 600, "assistant", "A", 9, "i"), (2, None, "tool", "", 9, "i"), (1, 1, None, "x", 9, "i"), (3, -1, "user", "a\n\nb" * 50, 9, "i")]
    got = C.recovered_turns(spark.createDataFrame(rows, schema)).collect()
    assert {r.conv_id for r in got} == {1, 2, 3, None}
    assert all(r.rendered.startswith("<|") for r in got)
    assert C.recovered_turns(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("line", ["A-level results are out", "Me-too movement", "Bot-generated text", "Q-tips are cotton"])
def test_a_word_with_a_dash_is_no_marker(line):
    assert C.marker(line) == (0, 0)
    assert C.pieces([line], [4])[0][2] == line


def test_markers_anywhere_and_only_of_the_recovered_role_are_taken_off():
    assert C.marker(" " * 200 + "User: hi")[0] == 2 and C.marker("User:" + " " * 300 + "hi")[1] == 305
    assert C.marker("A - yes") == (3, 4) and C.marker("bot -")[0] == 3
    assert C.pieces(["User: hi"], [2])[0][:3] == ("user", True, "hi")
    assert C.pieces(["User: hi"], [4])[0][:3] == ("assistant", True, "User: hi")
