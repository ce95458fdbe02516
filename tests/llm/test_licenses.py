"""License scans against a plain version, and the cases it must survive."""

import re
from collections import Counter, defaultdict

from ledgerlane.llm import license_scan as ls

LOWER = str.maketrans(ls.UPPER, ls.LOWER)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(text):
    own = words(text)
    places = []
    for phrase, label in ls.PHRASES:
        parts = phrase.split()
        places += [(label, i) for i in range(len(own)) if own[i:i + len(parts)] == parts]
    labels, accepted = {label for label, _ in places}, []
    for label, body in ls.TEMPLATES:
        template, votes = words(body), defaultdict(set)
        where = defaultdict(list)
        for at in range(len(template) - 2):
            where[tuple(template[at:at + 3])].append(at)
        for i in range(len(own) - 2):
            for at in where.get(tuple(own[i:i + 3]), ()):
                votes[i - at].add(at)
        spans, before = [], None
        for diagonal in sorted(votes):
            if before is None or diagonal - before > ls.SLACK:
                spans.append([])
            spans[-1] += [(diagonal, at) for at in votes[diagonal]]
            before = diagonal
        for span in spans:
            first, last = min(d + at for d, at in span), max(d + at for d, at in span) + 2
            covered = {at + k for _, at in span for k in range(3)}
            if len(covered) >= ls.COVERED * len(template) and last - first + 1 <= ls.LONGEST * len(template) + ls.SLACK:
                accepted.append((first, last, label, (len(covered) / len(template), len(covered))))
    accepted.sort(key=lambda a: a[:2])
    regions, reached = [], -1
    for span in accepted:
        if span[0] > reached:
            regions.append([])
        regions[-1].append(span)
        reached = max(reached, span[1])
    for region in regions:
        best = max(span[3] for span in region)
        labels |= {span[2] for span in region if span[3] == best}
    score = max((span[3][0] for span in accepted), default=0.0)
    starts = [i for _, i in places]
    return (len(own), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for label, _ in places})), ",".join(sorted(labels)), score)


def test_scan(spark):
    mit, apache, gpl = ls.TEMPLATES[0][1], ls.TEMPLATES[4][1], ls.TEMPLATES[5][1]
    shifted = mit.replace("free of charge", "wholly free of any charge").replace("associated documentation", "its documentation")
    texts = [
        "Plain prose.", "", None, "Released under the MIT License.", "licensed under CC BY-NC 4.0", "MIT mit license apache license, Apache  License",
        "ÀMIT license", mit, shifted, mit[:200], f"word {apache} and {gpl} end", gpl + " x " * 5 + gpl, "cc", "by", "cc by", "one two",
        "filler words " * 60_000 + shifted + " more", "mit license " * 3000, "GNU General\nPublic/License 3", "the software and to permit persons " * 50,
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, "other text"), (None, texts[4]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS line", "2 AS digest", "3 AS places", "4 AS span")
    got = Counter(tuple(r) for r in ls.digest(ls.scan(df)).collect())
    assert got == Counter((i, *plain(t)) for i, t in rows)
    found = {r[0]: r for r in got if r[0] is not None}
    assert found[8][6] == "mit" and 0.75 <= found[8][7] < 1 and found[9][6] == "" and found[4][6] == "cc-by,cc-by-nc"
    assert found[10][6] == "apache,gpl" and found[16][6] == "mit"


def test_no_python_and_one_small_broadcast(spark):
    """Built-in functions only; the texts are not shuffled."""
    df = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id bigint, text string")
    plan = ls.digest(ls.scan(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    for line in plan.splitlines():
        if "Exchange hash" in line:
            assert "text" not in line


def test_nothing(spark):
    assert ls.digest(ls.scan(spark.createDataFrame([], "doc_id bigint, text string"))).collect() == []
