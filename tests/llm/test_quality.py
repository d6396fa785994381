"""Quality rules and host verdicts against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from kerbside.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, salt int, host string, fails_base int"


def base(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def brute(rows):
    found, counts = [], defaultdict(Counter)
    for i, text, source in rows:
        n, chars, symbols, lines, repeated = own = base(text)
        fails = {"base": n < 20 or 100 * repeated > 30 * n, "symbols": n > 0 and 100 * symbols > 10 * n, "lines": n > 0 and 100 * lines > 5 * n,
                 "word_length": n > 0 and (chars < 3 * n or chars > 12 * n)}
        found.append((i, source, own, fails))
        counts[source].update({"n": 1, **{r: int(v) for r, v in fails.items()}})
    rates = defaultdict(dict)
    total, hosts = len(rows), len(counts)
    for r in quality.RULES:
        m = sum(c[r] for c in counts.values()) / max(total, 1)
        spread = 0
        if hosts > 1:
            between = sum(c["n"] * (c[r] / c["n"] - m) ** 2 for c in counts.values())
            spread = (between - (hosts - 1) * m * (1 - m)) / (total - sum(c["n"] ** 2 for c in counts.values()) / total)
        weight = min(max(m * (1 - m) / spread - 1, 1.0), 10_000.0) if spread > 1e-15 else 10_000.0
        for s, c in counts.items():
            rates[s][r] = (c[r] + m * weight) / (c["n"] + weight)
    out = []
    for i, source, own, fails in found:
        bad = rates[source]["base"] > 0.5 or any(fails[r] and rates[source][r] > 0.25 for r in quality.SOFT)
        out.append((i, *own, fails["base"], bad, not fails["base"] and not bad))
    return sorted(out, key=str)


def check(spark, rows, parts=3):
    docs = spark.createDataFrame([(i, t, "en", s, 0, "clash", 1, "clash", 1) for i, t, s in rows], SCHEMA).repartition(parts)
    got = quality.judge(docs)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", "kept"]
    found = sorted(map(tuple, got.select(*names).collect()), key=str)
    assert found == brute(rows)
    return found


def text(rng, n, bad=0.0):
    words = [rng.choice(["alpha", "be", "é", "delta9", "omega", "x"]) + rng.choice(["", "", "#*$" if rng.random() < bad else ""]) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", "\n", "\t"]) for w in words)


@pytest.mark.parametrize("seed", range(3))
def test_rules_and_verdicts_equal_plain_python(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(150):
        host = rng.choice(["clean", "short", "symbols", None, f"rare{k % 11}"])
        n = rng.choice([3, 8, 15]) if host == "short" and rng.random() < 0.9 else rng.choice([20, 40, 90])
        t = text(rng, n, 0.9 if host == "symbols" else 0.05)
        rows.append((k, t + t * rng.choice([0, 0, 0, 1]), host))
    found = check(spark, rows)
    assert any(x[-2] for x in found) and any(x[-1] for x in found)


def test_windows_that_overlap_touch_and_end_the_text(spark):
    w = [f"w{k}" for k in range(40)]
    join = " ".join
    rows = [join(w[:8] * 2), join(w[:8] + w[9:12] + w[:8]), join(w[:9] + w[:9]), join(["a"] * 9), join(["a"] * 8), join(["a"] * 7), join(w[:20] + w[5:15] + w[30:] + w[2:11]), join(["a", "b"] * 30)]
    check(spark, [(k, t, "s") for k, t in enumerate(rows)])


def test_odd_rows(spark):
    from tests.llm.conftest import ODD

    rows = [*[(k, t, "s") for k, t in enumerate(ODD)], (None, "no id", None), (None, "no id", None), (7, "a\nb \na\n\n\na\r\na", None), (8, "line\n" * 5000, "t"), (9, text(random.Random(1), 60_000), "t"),
            (10, "x " * 50_000, "t"), (11, " " * 200_000 + "\n" + "\t" * 200_000, "t"), (12, "<b>|#*$%&", "t")]
    check(spark, rows)
    check(spark, rows[:1])


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_host_of_few_documents_is_not_condemned_by_them(spark):
    rng = random.Random(4)
    rows = [(k, text(rng, 40), f"h{k % 6}") for k in range(300)]
    rows += [(1000, text(rng, 40, 1.0), "rare"), (1001, text(rng, 40, 1.0), "rare")] + [(2000 + k, text(rng, 40, 1.0), "spam") for k in range(100)]
    kept = {x[0]: x[-1] for x in check(spark, rows)}
    assert not any(kept[2000 + k] for k in range(100) if base(rows[-100 + k][1])[2] > 4)
    assert all(kept[k] for k in range(300) if base(rows[k][1])[4] == 0)
