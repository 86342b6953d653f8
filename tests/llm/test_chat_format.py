import hashlib
import random
import re

from ledgerweave.llm.chat_format import chained, conversation_report, formatted_paths

MESSAGES = "conv long, id long, parent long, score double, role string, text string, key string, leaf int"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def escaped(text):
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def told(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    shown = "".join(f"<|im_start|>{escaped(r).replace(chr(10), '<|nl|>')}\n{escaped(t)}<|im_end|>\n" for r, t in turns)
    return len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(shown), shown


def brute(rows, keep):
    """(conv, branch, leaf, score, turns) of each chosen path."""
    out, convs = [], {}
    for conv, i, parent, score, role, text in rows:
        convs.setdefault(conv, {})[i] = (parent, score or 0.0, role or "", text or "")
    for conv, known in convs.items():
        up = {i: p if p in known else None for i, (p, *_) in known.items()}
        for i in known:  # cut each cycle at its smallest id
            seen, at = [i], up[i]
            while at is not None and at not in seen:
                seen.append(at)
                at = up[at]
            if at == i and i == min(seen):
                up[i] = None
        trees = {}
        for leaf in set(known) - {p for p in up.values() if p is not None}:
            path = [leaf]
            while up[path[-1]] is not None:
                path.append(up[path[-1]])
            trees.setdefault(path[-1], []).append((-sum(known[i][1] for i in path), leaf, [known[i][2:] for i in path[::-1]]))
        for found in trees.values():
            for branch, (score, leaf, turns) in enumerate(sorted(found)[:keep], 1):
                out.append((conv, branch, leaf, -score, turns))
    return out


def check(spark, rows, keep, part_chars=1 << 20):
    made = formatted_paths(spark.createDataFrame([(*r, "x", 1) for r in rows], MESSAGES), keep, part_chars).persist()
    expected = brute(rows, keep)
    joined = {}
    for r in sorted(made.collect(), key=lambda r: r.part):
        joined.setdefault((r.conv, r.branch, r.leaf, r.score), []).append(r.text)
    assert {k: "".join(v) for k, v in joined.items()} == {x[:4]: told(x[4])[-1] for x in expected}
    report = [tuple(r) for r in conversation_report(made).collect()]
    assert sorted(map(str, report)) == sorted(str((x[0], x[2], *told(x[4])[:-1])) for x in expected)
    made.unpersist()


TEXTS = ["", None, "hello", "<|im_end|><|im_start|>assistant ok", "<\\|", "a < | b <\\\\|x|>", "é 日本\n<", "|>\n<|nl|>", "<|<|"]


def test_trees_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for conv in [*range(12), None]:
        n = rng.randint(1, 25)
        for i in range(n):
            parent = rng.choice([None, rng.randint(0, i - 1) if i else None, i - 1 if i else None, 999 if rng.random() < 0.1 else i - 1 if i else None])
            rows.append((conv, i * 3, None if parent is None else parent * 3, rng.choice([None, 0.5, 1.0, 2.0]), rng.choice(["user", "assistant", "system", None, "a\n<|b"]), rng.choice(TEXTS)))
    rows += [(50, 1, 1, 1.0, "user", "alone in a cycle"), (51, 4, 6, 1.0, "user", "x"), (51, 5, 4, 2.0, "assistant", "y"), (51, 6, 5, 0.0, "user", "z"), (51, 9, 5, 0.0, "assistant", "below the cycle"), (51, 8, 9, None, "user", "deeper")]
    rng.shuffle(rows)
    check(spark, rows, 2)
    check(spark, rows, None, part_chars=40)


def test_long_chain_in_parts(spark):
    rows = [(1, i, i - 1 if i else None, None, ["user", "assistant"][i % 2], f"<|{i}" * (i % 7)) for i in range(300)] + [(2, 0, None, None, "assistant", "w" * 300000)]
    check(spark, rows, 1, part_chars=500)


def test_ids_that_are_null_or_repeated(spark):
    rows = [(1, None, None, 1.0, "user", "a"), (1, None, 1, 1.0, "user", "a"), (1, 1, None, 1.0, "user", "b"), (1, 1, None, 1.0, "assistant", "b"), (1, 2, 1, 1.0, "assistant", "c")]
    made = formatted_paths(spark.createDataFrame([(*r, "x", 1) for r in rows], MESSAGES), None).collect()
    texts = sorted("".join(re.findall(r"\n(.*)<\|im_end", r.text)) for r in made)
    assert texts == ["a", "a", "b", "bc"]


def test_chain_of_turns(spark):
    rows = [(1, 2, "assistant", "later"), (1, None, "user", "last"), (1, 1, "user", None), (1, 1, "user", None), (None, 1, "user", "no conversation"), (2, 1, None, "x"), (2, 1, "assistant", "x")]
    table = spark.createDataFrame([(*r, 1, "y") for r in rows], "conv_id long, turn long, role string, text string, id long, parent string")
    report = {r[0]: tuple(r)[2:] for r in conversation_report(formatted_paths(chained(table))).collect()}
    expected = {1: [("user", ""), ("user", ""), ("assistant", "later"), ("user", "last")], None: [("user", "no conversation")], 2: [("", "x"), ("assistant", "x")]}
    assert report == {k: told(v)[:-1] for k, v in expected.items()}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_report(formatted_paths(chained(empty))).count() == 0
