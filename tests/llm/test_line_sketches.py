"""Line de-duplication of short and long lines against all pairs."""

import random

from gridtally.llm.linededup import line_report

SHORT = 48


def test_lines_around_the_sketch_widths_match_all_pairs(spark):
    rng = random.Random(5)
    lines = []
    for size in (3, 12, SHORT - 6, SHORT, SHORT + 1, SHORT + 9, 150, 600):
        base = [f"w{rng.randrange(4000)}" for _ in range(size)]
        for changed in (0.0, 0.05, 0.1, 0.11, 0.12, 0.2):
            other = [f"v{rng.randrange(4000)}" if rng.random() < changed else word for word in base]
            lines += [" ".join(other), " ".join(other[: int(size * 0.82)])]
    rng.shuffle(lines)
    docs = [(number, "\n".join(lines[number * 4 : number * 4 + 4])) for number in range(len(lines) // 4)]
    expected, seen = {}, []
    for doc_id, text in docs:
        expected[doc_id] = []
        for number, line in enumerate(text.split("\n")):
            words = set(line.split())
            if words and any(len(words & w) * 100 >= len(words | w) * 80 for w in seen):
                expected[doc_id].append(number)
            seen.append(words)
    report = line_report(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: list(r.removed) for r in report.collect()} == expected
    assert 0 < sum(map(len, expected.values())) < len(lines)
