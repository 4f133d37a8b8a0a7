"""The line rules against plain Python, and menus, boilerplate and clashing columns."""

import random
import re

from tillroll.llm import quality_rules

BLANK = " \t\n\x0b\x0c\r"


def judged_by_hand(text):
    """(n_failed_lines, lost_chars, clean_text) by plain Python."""
    split = lambda x: [w for w in re.split(f"[{BLANK}]+", x) if w]
    lines = [x for x in (text or "").split("\n") if split(x)]
    ends = [bool(re.search(r"[.!?…:;。！？][\"'”’»)\]]*[ \t\n\x0b\x0c\r]*$", x)) for x in lines]
    opened = [len(split(x)) < 5 and not e for x, e in zip(lines, ends, strict=True)]
    bad = []
    for k, x in enumerate(lines):
        words, low = split(x), x.lower()
        n = len(words)
        fails = n >= 5 and (not ends[k] or sum(c in "#*$%&|<>»«›‹→←•·" for c in x) > 0.3 * n or sum(bool(re.search("[!?]{2}$", w)) for w in words) > 0.3 * n)
        bare = re.sub(r"^[^\w]+|[^\w]+$", "", low)
        run = any(len(opened[a : a + 3]) == 3 and all(opened[a : a + 3]) for a in (k - 2, k - 1, k) if a >= 0)
        fails |= opened[k] and (any(c in x for c in "|»«›‹→←•·<>") or bare in quality_rules.MENU or run)
        fails |= n <= 12 and any(re.search(rf"(?<![^\W_]){re.escape(p)}(?![^\W_])", low) for p in quality_rules.BOILERPLATE)
        bad.append(fails)
    lost = sum(len("".join(split(x))) for x, b in zip(lines, bad, strict=True) if b)
    return sum(bad), lost, "\n".join(x for x, b in zip(lines, bad, strict=True) if not b)


def texts():
    rng = random.Random(2)
    parts = [
        "The river runs past the old mill.", "Home » News", "Next →", "Shop | All", "About us", "Kontakt", "A heading here", "One more", "Und so weiter", "Alle Rechte vorbehalten", "Lire la suite", "leer más ...", "WOW!! BIG!! NOW!! HERE!! TEN!!",
        "a line of words without an end", 'He said "so it is."', "a | b | c | d | e | f", "", " \t", "é", "Please accept all cookies, for this site has a lot of them to offer you today, as ever.", "cookies!", "price: 5 $ * 7 # 3 %.", "(yes.)",
    ]
    return [None, "", "\n\n", *("\n".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(150))]


def test_line_rules_equal_plain_python(spark):
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, _words string, _lines string, _facts int")
    got = quality_rules.clean_lines(df)
    assert got.columns[:5] == df.columns
    for r in got.collect():
        assert (r.n_failed_lines, r.lost_chars, r.clean_text) == judged_by_hand(rows[r.doc_id][1]), rows[r.doc_id][1]
        assert (r._words, r._lines, r._facts) == ("x", "y", 1)


def test_menus_fail_and_headings_stay(spark):
    rng = random.Random(1)
    prose = "\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(9)) + "." for _ in range(20))
    menu = "\n".join(["Home » News", "Shop » All", "Next »", "Products", "Our team", "Careers"] * 25)
    df = spark.createDataFrame([(1, menu), (2, "A fine heading\n" + prose), (3, menu + "\n" + prose)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.clean_lines(df).collect()}
    assert got[1].n_failed_lines == 150 and not got[1].kept
    assert got[2].n_failed_lines == 0 and got[2].kept and got[2].clean_text.startswith("A fine heading")
    assert got[3].clean_text == prose
    assert quality_rules.clean_lines(df.union(df)).count() == 6
