import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.cases import edge_docs, empty_docs
from tidebar.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least=3, top=200):
    """The contract by loops over whole dictionaries."""
    times, of_lang, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        words = TERM.findall((text or "").translate(LOWER))
        key = (lang or "", source or "")
        groups.add(key)
        times[key].update(words)
        docs[key[0]].update(set(words))
    kept = {lang: {w for w, n in c.items() if n >= least} for lang, c in docs.items()}
    for (lang, _), c in times.items():
        of_lang[lang].update({w: n for w, n in c.items() if w in kept[lang]})
    total = {g: sum(n for w, n in times[g].items() if w in kept[g[0]]) for g in groups}

    def p(n, all_, lang):
        return 1 + 10**9 * (n + 1) // (all_ + len(kept[lang]))

    out = []
    for g in groups:
        lang, source = g
        pairs, terms = [], []
        for h in groups:
            if h[0] == lang and h != g:
                value = 0
                for w in kept[lang]:
                    a, b = p(times[g][w], total[g], lang), p(times[h][w], total[h], lang)
                    value += (a - b) ** 2 // b
                pairs.append((h[1], value))
        for w in kept[lang]:
            if times[g][w]:
                a, b = p(times[g][w], total[g], lang), p(of_lang[lang][w], sum(of_lang[lang].values()), lang)
                if a > b:
                    terms.append((w, (a - b) ** 2 // b))
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, v, i + 1) for i, (item, v) in enumerate(found[:most])]
    return sorted(out)


def result(df, **kw):
    assert dict(df.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("rows,columns,held", [(128, 4096, 200_000), (2, 16, 50)])
def test_against_plain_loops(spark, rows, columns, held):
    rng = random.Random(3)
    data = []
    for i in range(260):
        lang = rng.choice(["en", "en", "de", None])
        words = [rng.choice(["Über", "the", "漢字", "a_b", f"w{'x' * rng.randrange(9)}", chr(97 + int(rng.paretovariate(1)) % 26)]) for _ in range(rng.randrange(0, 40))]
        data.append((" ".join(words), lang, rng.choice(["s0", "s0", "s1", "é", "Z", None, f"t{i % 5}"])))
    data += [(None, "xx", "only"), ("", "xx", "other"), ("solo", "yy", "one"), (data[0][0], data[0][1], data[0][2])]
    df = spark.createDataFrame(data, "text string, lang string, source string").repartition(5)
    assert result(divergence.audit(df, rows=rows, columns=columns, held=held)) == plain(data)


def test_defined_cases(spark):
    docs = edge_docs(spark)
    rows = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
    assert result(divergence.audit(docs)) == plain(rows)
    assert result(divergence.audit(empty_docs(spark))) == []


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    text = "Alpha beta, gamma-DELTA é漢 " * 20
    words = [w for part in divergence.terms_of(text) for w in part]
    assert [w.decode() for w in words] == TERM.findall(text.translate(LOWER))


def test_joint_cells_are_all_pairs_of_a_column():
    rng = np.random.default_rng(5)
    for depth in (1, 3, 6):
        side = 1 << depth
        grids = [rng.random((side, side)) < 0.2 for _ in range(2)]
        grids[0][side // 2 :, : side // 2] = False  # a whole quadrant without cells
        trees = [divergence.CountTree(*np.nonzero(g), depth) for g in grids]
        for a, b in ((0, 1), (0, 0)):
            (ra, ca), (rb, cb) = np.nonzero(grids[a]), np.nonzero(grids[b])
            found = {
                (int(trees[a].order[x]), int(trees[b].order[y]))
                for xs, ys in divergence.joint_cells(trees[a], trees[b]) for x, y in zip(xs, ys)
            }
            want = {(i, j) for i in range(len(ra)) for j in range(len(rb)) if ca[i] == cb[j]}
            if a == b:
                assert {tuple(sorted(x)) for x in found} == {tuple(sorted(x)) for x in want if x[0] != x[1]}
                assert len(found) * 2 == len([x for x in want if x[0] != x[1]])
            else:
                assert found == want
