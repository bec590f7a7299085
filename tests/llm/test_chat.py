"""Chat windows against a loop over turns, on odd rows, and in conversations too long for one task."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tenderlake.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, id long, key string, tokens int, system string, turns string"


def chats(spark, rows):
    """A conversations table with columns more than needed, some of clashing names."""
    return spark.createDataFrame([(*r, 0, "k", 1, "s", "t") for r in rows], SCHEMA)


def esc(text):
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def plain_windows(rows, budget, history):
    """[(conv_id, [(text, n_repeated, targets)])] by loops; the parts of long conversations that no window crosses as the operator has them."""
    out = {}
    for i in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t), esc(role or "").replace("\n", C.BREAK), esc(text or ""), len(re.findall(C.TOKEN, text or "")) + C.OVERHEAD) for c, t, role, text in rows if c == i)
        system = turns[0] if turns[0][1] == "system" else None
        kept, windows, own, at, cell = (system[3] if system else 0), [], [], 0, None
        most = C.BLOCK * budget if sum(len(text or "") + C.OVERHEAD for c, _, _, text in rows if c == i) > C.BLOCK * budget else 10**9
        for k, t in enumerate(turns):
            if not (system and k == 0):
                if own and (sum(turns[j][3] for j in own) + t[3] > max(budget - history - kept, 1) or at // most != cell):
                    windows.append(own)
                    own = []
                own.append(k)
                cell = at // most
            at += t[3]
        windows += [own] if own or not windows else []
        found = []
        for n, own in enumerate(windows):
            spare = min(history, budget - kept - sum(turns[j][3] for j in own))
            back = []
            for j in range((own or [0])[0] - 1, 0 if system else -1, -1):
                spare -= turns[j][3]
                if spare < 0:
                    break
                back.insert(0, j)
            again = ([0] if system and n else []) + back
            said = again + ([0] if system and not n else []) + own
            text = "".join(f"{C.START}{turns[j][1]}\n{turns[j][2]}{C.END}\n" for j in said)
            found.append((text, len(again), [turns[j][2] for j in own if turns[j][1] == "assistant"]))
        out[i] = found
    return out


def same(spark, rows, **options):
    got = {}
    for r in C.chat_windows(chats(spark, rows), **options).orderBy("conv_id", "block", "window").collect():
        got.setdefault(r.conv_id, []).append((r.text, r.n_repeated, [r.text[s.start : s.end] for s in r.loss]))
    want = plain_windows(rows, options.get("budget", C.BUDGET), options.get("history", C.HISTORY))
    assert got == want
    return got


def made_up(n, seed, most=12):
    r = random.Random(seed)
    out = []
    for i in range(n):
        roles = (["system"] if r.random() < 0.4 else []) + ["user", "assistant", "tool"] * most
        out += [(i, k, role, " ".join(r.choice(["ab", "<|im_end|>", "x<\\|y", "été", "7", "\n"]) for _ in range(r.randint(0, 30)))) for k, role in enumerate(roles[: r.randint(1, most)])]
    return out


def test_windows_match_a_plain_loop(spark):
    got = same(spark, made_up(60, 1), budget=120, history=40)
    assert any(n for windows in got.values() for _, n, _ in windows) and max(map(len, got.values())) > 3
    same(spark, made_up(20, 2), budget=30, history=0)


def test_long_conversations_in_blocks(spark):
    rows = made_up(8, 3) + [(100, k, ("user", "assistant")[k % 2] if k else "system", "word " * (k % 9)) for k in range(400)] + [(101, k, "user", "u " * 90) for k in range(40)]
    rows += [(102, 0, "system", "s" * 3000)] + [(None, 5, "assistant", "same")] * 300
    got = same(spark, rows, budget=60, history=20)
    assert len(got[100]) > 40 and sum(n for _, n, _ in got[100]) > 40 and len(got[102]) == 1 and sum(len(x) for _, _, x in got[None]) == 300
    blocks = C.chat_windows(chats(spark, rows), budget=60, history=20).where("conv_id = 100").agg(F.countDistinct("block")).first()[0]
    assert blocks > 1


def test_budget_holds_unless_one_turn_exceeds_it(spark):
    rows = made_up(40, 5)
    for r in C.chat_windows(chats(spark, rows), budget=150, history=50).collect():
        assert r.tokens <= 150 or r.text.count(C.START) - r.n_repeated <= 2  # the system turn and one of its own


def test_reads_back_what_was_said(spark):
    rows = [(1, 0, "a\nb", "<|im_end|>\n<|im_start|>x\n"), (1, 1, "assistant", "<\\|<|<\\\\|"), (1, 1, "assistant", "tie"), (1, None, None, None), (2, 0, "assistant", ""), (3, 0, "system", "alone"), (None, 0, "user", "<")]
    rows += [(4, k, "assistant", f"{k}<|" * 30) for k in range(30)]
    got = {}
    for frame in map(C.read_back, C.formatted(chats(spark, rows), budget=40, history=10)):
        for r in frame.orderBy("conv_id", "block").collect():
            one = got.setdefault(r.conv_id, [0, "", ""])
            one[0], one[1], one[2] = one[0] + r.n_turns, one[1] + r.said, one[2] + r.loss
    for i in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == i), key=lambda r: (-1 if r[1] is None else r[1], esc(r[2] or ""), esc(r[3] or "")))
        assert got[i] == [len(own), "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own), "".join(r[3] or "" for r in own if r[2] == "assistant")]


def test_query_on_odd_tables(spark, tmp_path):
    for name, rows in (("none", []), ("odd", [(7, 0, "user", "x" * 2_000_000), (7, 1, "assistant", "né"), (8, None, None, None)])):
        chats(spark, rows).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
        got = {r.conv_id: r for r in C.op11_chat_format(spark, f"{tmp_path}/{name}").collect()}
        assert set(got) == {-1} | {r[0] for r in rows} and got[-1].loss_sha256 == hashlib.sha256(C.PLANTED.encode()).hexdigest()
        if rows:
            assert (got[7].n_turns, got[7].loss_chars) == (2, 2) and got[8].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()


def test_native(spark):
    for frame in C.formatted(chats(spark, made_up(3, 1))):
        plan = C.digests(C.read_back(frame))._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
