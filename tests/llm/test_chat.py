import random
import re
from collections import Counter

from nextdist.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, position string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return {(r.conv_id, r.turn): r for r in C.quotation_links(df.repartition(3)).collect()}


def test_links_levels_and_order(spark):
    rows = [
        (1, 0, "user", "Hello there, how do I do it?\n\nSecond paragraph here."),
        (1, 1, "assistant", "> hello THERE,   how do I do it?\nLike this, I think."),
        (1, 2, "user", "Unrelated question number two."),
        (1, 3, "user", "On Monday someone wrote:\n> > Hello there, how do I do it?\n> Like this, I think.\n\nThat did not work."),
        (1, 4, "assistant", ">> Like this, I think.\n> That did not work.\nThen try again."),
        (1, 5, "user", "> nobody ever said this\nfine"),
        (2, 0, "user", "> Unrelated question number two.\nfrom elsewhere"),
        (2, 1, "user", None),
        (None, 0, "user", "a null conversation"),
        (None, None, None, "> a null conversation\nx"),
        (3, 0, "user", "> Second paragraph here.\n> and more text of nobody\nline match"),
    ]
    got = run(spark, rows)
    parent = {k: r.parent_turn for k, r in got.items()}
    assert parent[1, 1] == 0 and parent[1, 3] == 1 and parent[1, 4] == 3 and parent[1, 2] is None and parent[1, 5] is None
    assert got[1, 3].body == "That did not work." and got[1, 1].body == "Like this, I think." and got[1, 5].body == "fine"
    assert (got[2, 0].quoted_conv_id, got[2, 0].quoted_turn, got[2, 0].parent_turn) == (1, 2, None)
    assert (got[3, 0].quoted_conv_id, got[3, 0].quoted_turn) == (1, 0)
    assert got[2, 1].body == "" and got[1, 3].n_quotes == 2 and got[1, 2].n_quotes == 0
    assert [(got[1, t].root_turn, got[1, t].reply_depth) for t in range(6)] == [(0, 0), (0, 1), (2, 0), (0, 2), (0, 3), (5, 0)]
    assert [t for t in sorted(range(6), key=lambda t: got[1, t].position)] == [0, 1, 3, 4, 2, 5]
    assert got[1, 1].formatted == "<|assistant|>\nLike this, I think."


def test_long_chains_repeats_and_hot_lines(spark):
    rows = [(1, 0, "user", "message number zero is here")]
    for i in range(1, 40):
        rows.append((1, i, "user", f"> message number {'zero' if i == 1 else i - 1} is here\nmessage number {i} is here"))
    rows += [(2, i, "user", "the very same first line\nand then some") for i in range(30)] + [(2, 99, "user", "> the very same first line\nyes")]
    rows += [rows[5], rows[5]]
    got = run(spark, rows)
    assert [got[1, i].reply_depth for i in range(40)] == list(range(40))
    assert got[2, 99].parent_turn == 0
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    all_rows = C.quotation_links(df).collect()
    assert len(all_rows) == len(rows)
    assert sorted(r.position for r in all_rows if r.conv_id == 1) == list(range(42))


def test_partial_rewrapped_and_cross_conversation_quotes(spark):
    rows = [
        (5, 0, "user", "A first paragraph that is\nlong enough to wrap.\n\nA second one that is also\nwrapped.\n\nThe third is left out."),
        (5, 1, "user", "> A first paragraph\n> that is long enough to wrap.\n>\n> A second one that\n> is also wrapped.\nTwo of three."),
        (6, 0, "user", "Before it.\nYes it is.\nNo it is not.\nAfter it."),
        (6, 1, "user", "> Yes it is.\n> No it is not.\nTwo short lines."),
        (7, 1, "user", "> said in two conversations\nquoted before the own one says it"),
        (7, 3, "user", "said in two conversations"),
        (8, 2, "user", "said in two conversations"),
        (9, 0, "user", "short"),
        (9, 1, "user", "> short\n> and of nobody\nlinks nothing"),
    ]
    got = run(spark, rows)
    assert got[5, 1].parent_turn == 0 and got[6, 1].parent_turn == 0 and got[9, 1].parent_turn is None
    assert (got[7, 1].quoted_conv_id, got[7, 1].quoted_turn, got[7, 1].parent_turn) == (8, 2, None)


def test_empty_table(spark):
    assert C.quotation_links(spark.createDataFrame([], SCHEMA)).collect() == []


WHITE = " \t\n\x0b\x0c\r"


def brute(rows):
    """The linker in plain Python: every quote's parts against every message's parts."""
    normal = lambda x: re.sub(f"[{WHITE}]+", " ", x.lower()).strip(" ")

    def parts(x):
        lines = [y for y in x.split("\n") if normal(y)]
        return {x, *re.split(r"\n[ \t]*\n", x), *re.split(rf"(?<=[.!?])[{WHITE}]+|\n[ \t]*\n", x), *lines, *("\n".join(p) for p in zip(lines, lines[1:]))}

    bodies, quotes = [], []
    for _, _, _, text in rows:
        text, found, own = text or "", [], []
        lines = []
        for line in text.split("\n"):
            m = re.match(r"((?:[ \t]*>)+)[ \t]?", line)
            lines.append((m[1].count(">") if m else 0, line[m.end() :] if m else line, line))
        if not any(n for n, *_ in lines):
            bodies.append(text)
            quotes.append([])
            continue
        for i, (n, said, line) in enumerate(lines):
            after = lines[i + 1][0] if i + 1 < len(lines) else 0
            if n and i and lines[i - 1][0] == n:
                found[-1][1].append(said)
            elif n:
                found.append((n, [said]))
            elif not (after and re.search(r"\b(?:wrote|schrieb|a écrit|escribió)[ \t]*:[ \t]*$", line)):
                own.append(line)
        bodies.append("\n".join(own).strip(WHITE))
        quotes.append([(n, "\n".join(q)) for n, q in found if normal("\n".join(q))])
    first = {}
    for (conv, turn, *_), body in zip(rows, bodies, strict=True):
        for p in {normal(x) for x in parts(body)} - {""}:
            first.setdefault(p, {})[conv] = min(turn, first.get(p, {}).get(conv, turn))
    out, up = [], {}
    for (conv, turn, *_), qs in zip(rows, quotes, strict=True):
        votes = Counter()
        for level, q in qs:
            for x in parts(q):
                p = normal(x)
                if (x != q and len(p) < C.MIN_LINE) or p not in first:
                    continue
                at = first[p]
                if conv in at and at[conv] < turn:
                    votes[level, (conv, at[conv])] += len(p)
                elif others := [(c, t) for c, t in at.items() if c != conv]:
                    votes[level, min(others)] += len(p)
        best = max(((-level, n, at[0] == conv, at) for (level, at), n in votes.items()), default=None)
        at = best[3] if best else (None, None)
        if at[0] == conv and at[1] is not None:
            up[conv, turn] = min(at[1], up.get((conv, turn), at[1]))
        out.append([at, len(qs)])
    done = []
    for (conv, turn, *_), (at, n), body in zip(rows, out, bodies, strict=True):
        root, depth = turn, 0
        while (conv, root) in up:
            root, depth = up[conv, root], depth + 1
        done.append((conv, turn, at[0], at[1], at[1] if at[0] == conv else None, n, root, depth, body))
    return done


def threads(n=60, seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice(["sun", "moon", "river", "stone", "apple", "green", "walks", "over", "under", "never", "always", "Night"])
    sentence = lambda: " ".join(word() for _ in range(rng.randint(2, 9))) + rng.choice([".", "!", "?", ""])
    text = lambda: "\n\n".join(rng.choice([" ", "\n"]).join(sentence() for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3)))

    def quote(x):
        kind = rng.randrange(5)
        if kind == 0:
            x = rng.choice(x.split("\n\n"))
        elif kind == 1:
            x = rng.choice([y for y in x.split("\n") if y])
        elif kind == 2:
            at = rng.randrange(max(1, len(x) // 2))
            x = x[at : at + rng.randint(10, 80)]
        elif kind == 3:  # wrapped anew
            words = x.replace("\n\n", " \0 ").split()
            x = "\n".join(" ".join(words[i : i + 5]) for i in range(0, len(words), 5)).replace("\0", "")
        return "\n".join(rng.choice(["> ", ">", " > "]) + y for y in x.split("\n"))

    rows, said = [], []
    for c in range(n):
        for t in range(rng.randint(1, 7)):
            x = text()
            if said and rng.random() < 0.7:
                old = [r[3] for r in rows if r[0] == c]
                x = rng.choice(["", "Ann wrote:\n", "x " * 150 + "wrote:\n"]) + quote(rng.choice(old if old and rng.random() < 0.8 else said)) + "\n" + x
            rows.append((c, t, "user", x))
            said.append(x)
    return rows


def test_links_match_brute_force_over_generated_threads(spark):
    rows = [*threads(), (900, 0, "user", None), (900, 1, "user", ""), (900, 2, "user", "> \n>"), (901, 0, "user", "long line of text. " * 30_000), (901, 1, "user", "> " + "long line of text. " * 30_000 + "\nyes")]
    got = C.quotation_links(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    mine = sorted(tuple(r) for r in got.select("conv_id", "turn", "quoted_conv_id", "quoted_turn", "parent_turn", "n_quotes", "root_turn", "reply_depth", "body").collect())
    want = sorted(brute(rows))
    for a, b in zip(mine, want, strict=True):
        assert a == b
    assert sum(x[4] is not None for x in want) > 50 and sum(x[2] is not None and x[2] != x[0] for x in want) > 5
    order = sorted(got.collect(), key=lambda r: (r.conv_id, r.root_turn, r.reply_depth, r.turn))
    for a, b in zip(order, order[1:]):
        assert b.position == (a.position + 1 if a.conv_id == b.conv_id else 0)
