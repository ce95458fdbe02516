"""The label pass against one search for each rule, and its time on long lines."""

import random
import time

import regex
from pyspark.sql import functions as F

from ledgerlane import fixed
from ledgerlane.functions import labels as lb
from ledgerlane.functions.words import rule_of_words, spelled

WORDS = (
    "grand total net payable invoice value bill total amount paid due change cash payment credit card visa deposit balance items sub mrp rate "
    "discount tax taxable gst cgst quantity purchase date of order delivery manufactured by birth dob warranty expires at end expiry return deadline "
    "window period no. number id serial s/n imei 1 model name barcode sku customer brand manufacturer mfr retailer store sold buyer to à payer payé "
    "xx 12.50 Total CASH billing subtotal hsn imei2").split()
GAPS = [" ", "  ", "\t", ": ", " | ", "#", ".", " - ", "", ", ", " "]


def line(rng, n, strange=0.4):
    return "".join(rng.choice(WORDS) + rng.choice(GAPS if rng.random() < strange else [" "]) for _ in range(n))


def chosen(text, labels, after, rest, accepted):
    """All matches of each rule by itself; then leftmost first, longest, not overlapping."""
    found = []
    for number, (name, _, pattern) in enumerate(labels):
        for m in regex.finditer(rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{pattern}){after}{rest}", text):
            if accepted(text, m, name):
                found.append((m.start(), -m.end(), number))
    out, end = [], 0
    for start, stop, number in sorted(found):
        if start >= end:
            out.append((start, -stop, number))
            end = -stop
    return out


def maker(text, m, name):
    before = text[:m.start()]
    return name != "brand" or not before.strip() or regex.search(r"(?:\t[ \t]*|\|[ \t]*| {2,})\Z", before) or regex.search("[:#]", m.group())


def field_spans(text):
    spans = []
    for start, end, number in chosen(text, fixed.FIELD_LABELS, r"(?=\Z|[\s:#])", "", lambda *_: True):
        separator = regex.match(r"\s*[:#]\s*|\s+-\s+|\s+|\Z", text[end:]).group()
        explicit = bool(regex.search(r"[:#]|\s-\s", separator))
        if explicit or start == 0 or regex.search(r"(?:\t|[|;]| {2,})\s*\Z", text[:start]):
            spans.append((fixed.FIELD_LABELS[number][0], fixed.FIELD_LABELS[number][1], start, end + len(separator), explicit))
    return spans


def test_labels_of_random_lines(spark):
    rng = random.Random(5)
    lines = [line(rng, rng.randrange(1, 14)) for _ in range(1500)] + [line(rng, 400, 0.9) for _ in range(3)]
    lines += ["", "   Brand x", "Brand:", "grand total change 3", "grand total quantity", "credit card paid 5", "date due date due date", "a\tBrand", "ſerial no 1"]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, t string").repartition(8)
    roles = {r.n: [(x.start, x.end, x.role, x.priority) for x in r.x] for r in df.select("n", lb.role_labels(F.col("t")).alias("x")).collect()}
    fields = {r.n: [tuple(x) for x in r.x] for r in df.select("n", lb.field_labels(F.col("t")).alias("x")).collect()}
    for n, text in enumerate(lines):
        want = chosen(text, fixed.ROLE_LABELS, r"(?![\p{L}\p{N}])", r"[ \t:#.]*", maker)
        assert roles[n] == [(s, e, fixed.ROLE_LABELS[k][0], fixed.ROLE_LABELS[k][1]) for s, e, k in want], text
        assert fields[n] == field_spans(text), text


def test_every_word_of_the_trie_is_a_label():
    for labels in (fixed.ROLE_LABELS, fixed.FIELD_LABELS):
        patterns = tuple(p for _, _, p in labels)
        for word, number in rule_of_words(patterns).items():
            hits = [k for k, p in enumerate(patterns) if regex.fullmatch(p, word)]
            assert hits and hits[0] == number, word
    assert spelled(r"s(?:a|b)?\s+c") == ["s\0c", "sa\0c", "sb\0c"]


def test_twice_the_line_costs_twice_the_time(spark):
    """A line of 200,000 characters and more."""
    rng = random.Random(6)
    seconds = []
    for words in (18_000, 36_000):
        text = line(rng, words, 0)
        df = spark.createDataFrame([(text,)], "t string").select(F.size(lb.role_labels(F.col("t"))).alias("n"))
        df.collect()
        start = time.perf_counter()
        assert df.collect()[0].n > words / 4
        seconds.append(time.perf_counter() - start)
    assert len(text) > 200_000 and seconds[1] < 4 * seconds[0] and seconds[1] < 30


def test_whole_texts_are_read_alike(spark):
    """Both forms of the pass, and brute force."""
    rng = random.Random(8)
    texts = ["\n".join(line(rng, rng.randrange(9)) for _ in range(rng.randrange(6))) for _ in range(300)]
    texts += [None, "", "\r\n", "Total\r\nBrand x\n\n12", "Grand Total:\n\n100", "grand total change 3\ncredit card paid 5", "  Brand x", "Invoice no 5\rTotal 6"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").repartition(4)
    rows = df.select("n", lb.annotate(F.col("t")).alias("a"), lb.annotate_texts(F.col("t")).alias("b"), lb.labels_of_lines(F.col("t")).alias("c")).collect()
    for r in rows:
        assert r.a == r.b, texts[r.n]
        if texts[r.n] is not None:
            want = [chosen(x, fixed.ROLE_LABELS, r"(?![\p{L}\p{N}])", r"[ \t:#.]*", maker) for x in regex.split("\r?\n", texts[r.n])]
            assert [[(x.start, x.end) for x in own] for own in r.c] == [[(s, e) for s, e, _ in own] for own in want], texts[r.n]


def test_plain_lines_are_read_without_ignoring_case():
    from ledgerlane.functions import line_labels as ll

    rng = random.Random(11)
    lines = [line(rng, rng.randrange(1, 14)) for _ in range(1500)] + ["TOTAL", "x Total", "xtotal", "_total", "S/N 5", "K total", ""]
    for (patterns, shut, rest), _ in (ll._ROLES, ll._READER):
        for text in filter(str.isascii, lines):
            wanted = [(m.start(), m.end(2), m[1].lower()) for m in ll._longest(patterns, shut, rest).finditer(text)]
            assert [(m.start(), m.end(2), m[1]) for m in ll._longest_plain(patterns, shut, rest).finditer(text.lower())] == wanted
