import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from sparkwatch.llm import templates
from sparkwatch.llm.templates import FIELD, Templates

SCHEMA = "doc_id long, text string, n_dropped string, pos int"


def brute(rows, spec):
    """{doc_id: dropped line numbers} with plain dictionaries."""
    lines = []
    for i, text in rows:
        for pos, raw in enumerate((text or "").split("\n") if text is not None else []):
            w = [x for x in re.split("[\x20\x09-\x0d]+", raw) if x]
            w = [FIELD if re.search("[0-9]", x) else x for x in w]
            if len(w) >= spec.tokens:
                lines.append((i, pos, tuple(w), (len(w), tuple(w[: spec.depth]))))
    leaves = defaultdict(list)
    for line in lines:
        leaves[line[3]].append(line)
    template = {}
    for leaf, members in leaves.items():
        left = Counter(w for _, _, w, _ in members)
        for _ in range(spec.rounds):
            total = sum(left.values())
            made = []
            for at in range(leaf[0]):
                count = Counter()
                for w, n in left.items():
                    count[w[at]] += n
                token, n = count.most_common(1)[0] if count else ("", 0)
                made.append(token if 2 * n > total else FIELD)
            fits = {w for w in left if sum(x == y != FIELD for x, y in zip(w, made)) >= leaf[0] * spec.agree}
            for w in fits:
                template[leaf, w] = tuple(made)
                del left[w]
        for w in left:
            template[leaf, w] = w
    where = defaultdict(list)
    for i, pos, w, leaf in lines:
        t = template[leaf, w]
        if sum(x != FIELD for x in t) >= spec.constants:
            where[leaf, t].append((i, pos))
    out = defaultdict(set)
    for found in where.values():
        known = [x for x in found if x[0] is not None]
        if len({i for i, _ in known}) >= spec.documents:
            for i, pos in known:
                if (i, pos) != min(known):
                    out[i].add(pos)
    return out


def corpus(seed, n=80):
    r = random.Random(seed)
    words = "red green blue one two gray über old new sun moon".split()
    rows = []
    for i in r.sample(range(1000), n):
        lines = []
        for _ in range(r.randint(0, 8)):
            lines.append(
                r.choice(
                    [
                        lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 9))),
                        lambda: f"Call +1 ({r.randint(100, 999)}) 555 now {r.choice(words)} today ok",
                        lambda: f"All rights reserved. {r.choice(words)}",
                        lambda: f"{r.random()} {r.random()} {r.random()}",
                        lambda: f"page {r.randint(1, 99)} of  {r.randint(1, 99)}\tby {r.choice(['me', 'you'])} and {r.choice(words)} \r",
                        lambda: "",
                    ]
                )()
            )
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_python(spark, seed):
    spec = Templates(documents=4)
    rows = corpus(seed) + [(2001, None), (2002, ""), (2003, "\n\n"), (None, "All rights reserved. red\nCall +1 (1) 555 now red today ok")]
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], SCHEMA).repartition(3)
    out = templates.drop_templates(df, spec=spec)
    assert out.columns == ["doc_id", "text", "pos", "n_dropped"]
    want = brute(rows, spec)
    assert sum(map(len, want.values())) > 20
    for r in out.collect():
        text = dict(rows)[r["doc_id"]]
        gone = want.get(r["doc_id"], set())
        kept = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        assert (r["text"], r["n_dropped"]) == (kept, len(gone)), r


def test_variable_fields_and_clean_lines(spark):
    rows = [(i, f"Own line number of document {'abcdefghij'[i]}x{'klmnopqrst'[i]} alone here\nSent from host h{i} by user {'uvwxyzabcd'[i]} at noon") for i in range(10)]
    rows = [(i, t.replace("Own line number of document", " ".join(random.Random(i).choices("alpha beta gamma delta eps".split(), k=6)))) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in templates.drop_templates(df).collect()}
    for i, t in rows:
        assert got[i] == (t if i == 0 else t.split("\n")[0])


def test_report(spark):
    rows = [(i, "Released under the MIT License.\nlast") for i in range(6)] + [(9, None), (3, "Released under the MIT License.\nlast")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in templates.report(df).collect())
    whole, left = rows[0][1], "last"
    want = [(i, 2, 0 if i == 0 else 1, len(whole if i == 0 else left), hashlib.sha256((whole if i == 0 else left).encode()).hexdigest()) for i, _ in rows if i != 9]
    assert got == sorted([*want, (9, 0, 0, 0, hashlib.sha256(b"").hexdigest())])
    assert templates.report(df.limit(0)).collect() == []


def drain(lines, agree=0.7):
    """One line after the other joins the group it is most like, or begins one: {line: number of its group}."""
    groups, of = [], {}
    for w in lines:
        likes = [sum(x == y for x, y in zip(w, g)) / len(w) for g in groups]
        best = max(range(len(groups)), key=likes.__getitem__, default=None)
        if best is None or likes[best] < agree:
            groups.append(list(w))
            best = len(groups) - 1
        else:
            groups[best] = [x if x == y else FIELD for x, y in zip(w, groups[best])]
        of[" ".join(w)] = best
    return of


@pytest.mark.parametrize("kinds", [3, 12])
def test_many_equal_templates_in_one_leaf(spark, kinds):
    r = random.Random(kinds)
    names = [a + b for a in "kalorimutanesi" for b in "xyzvwq"][:40]
    tails = [[f"{'abcdefghijkl'[k]}{x}" for x in ("read", "via", "our", "post", "today")] for k in range(kinds)]
    rows = []
    for i in range(kinds * 20):
        tail = tails[i % kinds]
        rows.append((i, " ".join(["Click", "here", "to", *tail[:3], r.choice(names), *tail[3:]])))
    of = drain([t.split() for _, t in rows])
    assert len(set(of.values())) == kinds
    first = {}
    for i, t in rows:
        first.setdefault(of[t], i)
    got = {x["doc_id"]: x["n_dropped"] for x in templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(first[of[t]] != i) for i, t in rows}
