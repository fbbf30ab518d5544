import random
import re

from lontar.llm import pii

DOCS = "doc_id long, text string, spans string, n_ip int"
PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def checksum(digits):
    doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(digits[::-1])]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def by_hand(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = [True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True, 14 <= len(digits) <= 19 and checksum(digits), 10 <= len(digits) <= 15][kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_rules_against_plain_patterns():
    r = random.Random(3)
    for alphabet in ("19.", "1a@.-", "+1() -.", "4 -0", "12345.@a+é \n"):
        for _ in range(4000):
            text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
            assert pii.base_spans(text) == by_hand(text), text


def test_best_segmentation_against_all():
    weights, r = pii.trained(), random.Random(4)

    def every(run, scores, at):
        if at == len(run.tokens):
            return [0.0]
        out = every(run, scores, at + 1)
        for (i, j, _), row in zip(run.segments, scores, strict=True):
            if i == at:
                out = out + [s + x for x in row for s in every(run, scores, j)]
        return out

    for text, _ in pii.synthetic(60, r.random()):
        for run in pii.runs(text):
            if len(run.tokens) > 9:
                continue
            scores = run.scores(weights)
            totals = every(run, scores, 0)
            at = {(run.tokens[i][0], run.tokens[j - 1][1]): s for s, (i, j, _) in enumerate(run.segments)}
            got = sum(scores[at[a, b]][k] for a, k, b in pii.decode(run, pii.Scores(weights)))
            assert abs(got - max(totals)) < 1e-9
            import numpy as np

            assert abs(pii.gradient(run, set(), weights)[0] + np.logaddexp.reduce(totals)) < 1e-9


def test_gradient_by_differences():
    import numpy as np

    weights = pii.trained() * 0.3
    run = next(pii.runs("call +1 (269) 555-3296 4524132264652876 now"))
    gold = {(run.segments[0][0], run.segments[0][1], 3)}
    g = pii.gradient(run, gold, weights)[1]
    for k, f in [(3, 0), (2, pii.FEATURES.index("check")), (3, pii.FEATURES.index("plus"))]:
        other = weights.copy()
        other[k, f] += 1e-5
        assert abs((pii.gradient(run, gold, other)[0] - pii.gradient(run, gold, weights)[0]) / 1e-5 - g[k, f]) < 1e-3
    assert np.isfinite(g).all()


def test_held_out_lines():
    weights = pii.trained()
    lines, scores = pii.synthetic(1200, 99), pii.Scores(weights)
    right = sum(sorted(x for r in pii.runs(t) for x in pii.decode(r, scores)) == sorted(s) for t, s in lines)
    assert right >= 0.95 * len(lines)


def test_documents(spark):
    rows = [(1, "write to a.b@c.de or +1 (269) 555-3296 4524132264652876."), (2, None), (None, ""), (2, "x 10.0.0.1\n" * 3), (4, "no data. " * 20_000), (5, "tel (389) 555-5010, é ssn 123-45-6789")]
    got = pii.find_pii(spark.createDataFrame([(*x, "clash", 3) for x in rows], DOCS)).collect()
    assert [x.doc_id for x in got] == [r[0] for r in rows]
    assert [x.n_email for x in got] == [1, 0, 0, 0, 0, 0] and [x.n_ip for x in got] == [0, 0, 0, 3, 0, 0]
    assert got[0].spans == "email:9:17,phone:21:38,card:39:55"
    assert got[5].spans == "phone:4:18,id:26:37"
    assert pii.find_pii(spark.createDataFrame([], DOCS)).collect() == []
    docs = spark.createDataFrame([(1, rows[0][1], "s", 0), (2, None, "t", 1)], DOCS)
    assert [x.text for x in pii.redacted(docs).collect()] == ["write to [EMAIL] or [PHONE] [CARD].", None]


def test_long_runs_of_digits():
    scores = pii.Scores(pii.trained())
    assert pii.base_spans("x " + "0" * 5000 + ".1.2.3") == [(2, 1, 5008)]
    assert pii.base_spans("x " + "9" * 5000 + ".1.2.3 " + "0" * 6000) == []
    for text in ("x " + "0" * 5000 + ".1.2.3", "9" * 5000 + ".1.2.3", "1." * 4000, "7" * 20_000):
        base, every = pii.spans_of(text, scores)
        assert set(base) <= set(every)


def test_a_text_of_numbers_takes_linear_time():
    import time

    r, scores = random.Random(5), pii.Scores(pii.trained())
    text = " ".join(str(r.randrange(10 ** r.randint(1, 9))) for _ in range(8_000))
    taken = []
    for n in (len(text) // 4, len(text)):
        start = time.process_time()
        pii.spans_of(text[:n], scores)
        taken.append(time.process_time() - start)
    assert taken[1] < 8 * taken[0] + 1
