import collections
import math
import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED, PLAIN = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, n int"

#: Nulls, empty and blank texts, ties, repeated rows, other scripts, a long line.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, "Één zwei ٣ 日本語\x0bthree\r\n!!!"), (None, "no id"), (7, "word " * 3000), (8, "a b"), (9, "A  B")]


def docs(spark, rows, source="s"):
    """A documents table with columns more than needed, some of clashing names."""
    return spark.createDataFrame([(i, t, None, source if not callable(source) else source(i), None if t is None else len(t), 0, "k", 1) for i, t in rows], SCHEMA)


def prose(n, seed=0, words=120, vocabulary=400):
    """Made-up texts: near copies of each other in groups, the rest apart."""
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(vocabulary)]
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            text = r.choice(out)[1].split(" ")
            for _ in range(r.choice((0, 1, 1, 2, 4, 9))):
                text[r.randrange(len(text))] = r.choice(pool)
        else:
            text = [r.choice(pool) for _ in range(r.randint(3, words))]
        out.append((i, " ".join(text)))
    return out


def shingles(text, size=3):
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def groups(ids, linked):
    """Smallest id reachable of each id."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def bm25(texts, query, k):
    count = {i: collections.Counter(PLAIN.findall((t or "").translate(LOWER))) for i, t in texts.items()}
    n, df = len(texts), collections.Counter(w for c in count.values() for w in c)
    mean = sum(sum(c.values()) for c in count.values()) / n
    found = []
    for i, c in count.items():
        size = sum(c.values())
        s = sum(m * math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w, m in count[query].items() if w in c)
        if s > 0:
            found.append((-round(s, 7), i))
    return [i for _, i in sorted(found)[:k]]
