"""Small documents with the cases every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, line string, node string, path string, value string"
WORDS = "amber basin cedar delta ember field grove haven inlet jetty knoll ledge marsh north ocean plain quarry ridge shore tower upper vista water yield zenith acorn brook cliff dunes eagle".split()


def prose(rng, n):
    out = []
    while len(out) < n:
        k = rng.randint(4, 9)
        out += [rng.choice(WORDS).capitalize(), *[rng.choice(WORDS) + rng.choice(["", "", "s", "er"]) for _ in range(k - 2)], rng.choice(WORDS) + "."]
    return out[:n]


def rows(texts, langs=None):
    """(doc_id, text, ...) rows with extra columns whose names operators use inside."""
    return [(i, t, (langs or {}).get(i, "en"), f"src{i % 3}" if i is not None else None, len(t) if t is not None else None, "k", "l", "n", "p", "v") for i, t in texts]


def corpus(seed=5, n=40):
    """Ids and texts: prose, exact copies, near copies, shared lines, nulls, empties, a long text, repeated rows."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        words = prose(rng, rng.randint(30, 120))
        lines = [" ".join(words[k : k + 25]) for k in range(0, len(words), 25)]
        if i % 4 == 0:
            lines.insert(rng.randint(0, len(lines)), "  This line of words Repeats in many documents.\t")
        texts.append((i, "\n".join(lines)))
    for i in range(5):
        texts.append((n + i, texts[0][1]))
    base = texts[1][1].split(" ")
    for i in range(6):
        w = list(base)
        w[rng.randrange(len(w))] = f"edit{i}"
        texts.append((n + 10 + i, " ".join(w)))
    texts += [(n + 20, None), (n + 21, ""), (n + 22, "\n\n"), (n + 23, "é ß 東京 Ω"), (n + 24, "word"), (n + 25, " ".join(prose(rng, 3000)))]
    texts += [(3, texts[3][1]), (None, texts[5][1]), (None, None)]
    return texts
