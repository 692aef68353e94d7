"""Section paths against a parser that reads one line after another, and the automaton against its own walk."""

import random
import re

import pytest

from folioflow.operators import scans
from folioflow.plans import sections as S

DIGITS = "零一二三四五六七八九"


def numeral(t):
    m = re.fullmatch(f"([{DIGITS}]?)十([{DIGITS}]?)", t)
    if m:
        return (DIGITS.index(m[1]) if m[1] else 1) * 10 + (DIGITS.index(m[2]) if m[2] else 0)
    return DIGITS.index(t) if len(t) == 1 and t in DIGITS else None


def match(pattern, line):
    return re.search(pattern.replace("(?U)", ""), line)


def brute_chinese(prefixes, volume, strict):
    chapter = section = sub = None
    out = []
    for table, prefix in enumerate(prefixes):
        lines = [x.strip() for x in prefix.splitlines() if x.strip()]
        shown = [re.sub(r"^\s*#{0,6}\s*", "", x) for x in lines]

        def title(k):
            t = shown[k]
            return 0 < len(t) <= 30 and not match(S.SENTENCE_END, t) and not any(x in t for x in ("…", "<table", "计量单位")) and not t.startswith("工作内容") and not any(match(p, t) for p in (S.CHAPTER, S.SECTION, S.SUBSECTION, S.PARAGRAPH))

        for k, line in enumerate(lines):
            after = lines[k + 1 : k + 6]
            work_next = bool(after) and bool(match(S.WORK, after[0]))
            if match(S.CONTENTS, line):
                continue
            if m := match(S.CHAPTER, line):
                name = m[2] or (shown[k + 1] if k + 1 < len(lines) else "")
                if numeral(m[1]) is not None and name and not any(match(S.CHAPTER, x) for x in lines[k + 1 :]):
                    chapter, section, sub = numeral(m[1]), None, None
                    out.append((table, f"{volume}.{chapter}", name))
            elif m := match(S.SECTION, line):
                near = False
                for x in after:
                    if strict and (match(S.CHAPTER, x) or match(S.SECTION, x)):
                        break
                    if match(S.WORK, x):
                        near = True
                        break
                if numeral(m[1]) is not None and near and not (strict and match(S.SENTENCE_END, shown[k])):
                    if chapter is None:
                        chapter = numeral(m[1])
                        out.append((table, f"{volume}.{chapter}", shown[k]))
                    else:
                        section, sub = numeral(m[1]), None
                        out.append((table, f"{volume}.{chapter}.{section}", shown[k]))
            elif m := match(S.SUBSECTION, line):
                lower = bool(after) and any(match(p, after[0]) for p in ([S.PARAGRAPH, S.WORK] if strict else [S.SUBSECTION, S.PARAGRAPH, S.WORK]))
                if section is not None and lower and not (strict and match(S.SENTENCE_END, shown[k])):
                    sub = int(m[1])
                    out.append((table, f"{volume}.{chapter}.{section}.{sub}", shown[k]))
            elif m := match(S.PARAGRAPH, line):
                if work_next:
                    if sub is None:
                        if section is None or k == 0 or not title(k - 1):
                            continue
                        out.append((table, f"{volume}.{chapter}.{section}.X", shown[k - 1]))
                        sub = "X"
                    out.append((table, f"{volume}.{chapter}.{section}.{sub}.{'X' if sub == 'X' or not m[1] else int(m[1])}", shown[k]))
            elif section is not None and title(k) and work_next:
                out.append((table, f"{volume}.{chapter}.{section}.X", shown[k]))
                sub = "X"
    return out


def brute_volumes(prefixes):
    volume, chapter, out = 0, None, []
    for table, prefix in enumerate(prefixes):
        seen = set()
        for line in (x.strip() for x in prefix.splitlines()):
            shown = re.sub(r"^\s*#{0,6}\s*", "", line).strip()
            if not line or re.search(r"[.…]{2,}", line):
                continue
            code = None
            if m := match(S.VOLUME, shown):
                volume = numeral(m[1]) or volume
                continue
            if m := match(S.CHAPTER, line):
                if numeral(m[1]) is not None and m[2]:
                    chapter = numeral(m[1])
                    code, name = f"{volume}.{chapter}", m[2]
            elif (m := match(S.SUBSECTION, line)) and chapter is not None:
                code, name = f"{volume}.{chapter}.{int(m[1])}", shown
            if code and code not in seen:
                seen.add(code)
                out.append((table, code, name))
    return out


LINES = ["# 第{c}章 墙{n}", "第{c}章", "## {c}、节{n}", "{c}、规则{n}。", "{n}. 小节{n}", "{n}. 条文{n}；", "({n}) 段{n}", "()段", "工作内容：砌", "工作内容：运", "裸行{n}", "正文是一个句子。", "", "  ", "第{c}章 目录 ......{n}", "单位：m3", "第{c}册 卷", "{n}．全角", "廿、怪"]


def books(seed):
    rng = random.Random(seed)
    line = lambda: rng.choice(LINES).format(c=rng.choice(["一", "二", "十", "十二", "二十", "三十一", "廿"]), n=rng.randint(1, 30))
    return {f"book{b}": ["\n".join(line() for _ in range(rng.randint(0, 14))) for _ in range(rng.choice([1, 3, 25]))] for b in range(9)}


def frame(spark, found, volume="A"):
    return spark.createDataFrame([(f, k, p, volume) for f, ps in found.items() for k, p in enumerate(ps)] + [(None, 0, "第一章 x", "A"), ("empty", 0, None, "A")], "file string, table_no int, prefix string, volume string")


def rows(found):
    return [(r.file, r.table_no, r.code, r.name) for r in found.orderBy("file", "table_no", "line_no", "place").collect()]


@pytest.mark.parametrize("strict", [False, True])
def test_chinese_sections(spark, monkeypatch, strict):
    monkeypatch.setattr(scans, "BLOCK", 7)
    found = books(5)
    want = [(f, *x) for f in sorted(found) for x in brute_chinese(found[f], "A", strict)]
    assert rows(S.sections(frame(spark, found), "chinese", strict)) == want and len({x[2].count(".") for x in want}) >= 3
    if strict:
        mixed = [(f, *x) for f in sorted(found) for x in brute_chinese(found[f], "BJ", strict)]
        assert rows(S.sections(frame(spark, found), "mixed", strict)) == mixed


def test_sections_with_volumes(spark, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK", 5)
    found = books(6)
    want = [(f, *x) for f in sorted(found) for x in brute_volumes(found[f])]
    assert rows(S.sections(frame(spark, found), "volumes")) == want
    firsts = {}
    for f, t, c, n in want:
        firsts.setdefault((f, c), (f, t, c, n))
    assert sorted(rows(S.sections(frame(spark, found), "volumes", once=True))) == sorted(firsts.values())


def test_lettered_sections(spark):
    prefix = "## A.1 Walls\n## B2Floors\n## C\n\nRoofs\n## D\n## E\nA.3 tall\nA.4 tall\nF words\nG --> [x]\nH.1 Contents....12\n## I\nText....3\n"
    got = [(c, n) for _, _, c, n in rows(S.sections(frame(spark, {"f": [prefix]}), "letters"))]
    assert got == [("A.1", "Walls"), ("B2", "Floors"), ("C", "Roofs"), ("E", "A.3 tall"), ("A.4", "tall"), ("F", "words"), ("G", "--> [x]")]
    strict = [(c, n) for _, _, c, n in rows(S.sections(frame(spark, {"f": [prefix]}), "letters", strict=True))]
    assert strict == [x for x in got if x[0] not in "FG"]
    with pytest.raises(ValueError):
        S.sections(frame(spark, {}), "roman")


def test_no_sections(spark):
    for system in S.SYSTEMS:
        assert rows(S.sections(frame(spark, {}).where("file = 'empty'"), system)) == []


@pytest.mark.parametrize("n", [0, 1, 4, 5, 200])
def test_automaton_walks(spark, monkeypatch, n):
    monkeypatch.setattr(scans, "BLOCK", 4)
    rng = random.Random(n)
    moves = [[(rng.randrange(3), rng.choice([None, "a", "b"])) for _ in range(3)] for _ in range(4)]
    sequence = [(k + 1, rng.choice([0, 1, 2, 3, None]), rng.randrange(100), f"x{k}") for k in range(n)]
    out = scans.automaton(spark.createDataFrame(sequence, "number long, event int, value int, more string").repartition(3), "number", "event", "value", moves, ["a", "b"])
    state, held, want = 0, {"a": None, "b": None}, []
    for number, event, value, more in sequence:
        want.append((number, more, state, held["a"], held["b"]))
        if event is not None:
            state, register = moves[event][state]
            if register:
                held[register] = value
    assert sorted((r.number, r.more, r.before.state, r.before.a, r.before.b) for r in out.collect()) == want
