"""The array automata against a line-by-line specification, on random flags."""

import random

import numpy as np

from lineweave.operators import scan as S


def specified(f, e, detectors, keep):
    codes, active, end, single, multi = [], 0, 0, False, False

    def start(i):
        for begin, stop, number in detectors:
            if e[i] & begin:
                return number, stop, bool(stop and e[i] & stop)
        return 0, 0, False

    for i in range(len(f)):
        if f[i] & (S.TRUE_BLANK | S.IGNORED):
            codes.append(None)
            continue
        changed = False
        if detectors:
            old = active
            if active and single:
                old = 0
                active, end, single = start(i)
            elif active:
                if end and e[i] & end:
                    active, end = 0, 0
            else:
                active, end, single = start(i)
            changed = old != active
            multi = multi and not changed
        comment = not multi and bool(f[i] & S.SINGLE)
        if not comment:
            if multi:
                comment, multi = True, not f[i] & S.CLOSE
            elif f[i] & S.OPEN:
                comment, multi = True, not f[i] & S.CLOSED_AGAIN
                if f[i] & S.CLOSED_AGAIN and not keep and f[i] & S.CODE_AROUND:
                    comment = False
        codes.append((active, comment, changed))
    return codes


def test_random_flags():
    rng = random.Random(7)
    for round_ in range(1500):
        detectors = [(1, 2, 1), (4, 0, 1), (16, 32, 2)] if round_ % 2 else []
        keep = bool(round_ % 3)
        f, e, offsets, want = [], [], [0], []
        for _ in range(rng.randint(1, 3)):
            ff, ee = [], []
            for _ in range(rng.randint(0, 9)):
                flags = S.TRUE_BLANK if rng.random() < 0.15 else sum(b for b in (S.SINGLE, S.OPEN, S.CLOSE, S.BLANK, S.CODE_AROUND) if rng.random() < 0.3)
                if flags & S.OPEN and rng.random() < 0.4:
                    flags |= S.CLOSED_AGAIN | S.CLOSE
                ff.append(flags)
                ee.append(rng.choice([0, 0, 0, 1, 2, 3, 4, 16, 32, 48]))
            want += specified(ff, ee, detectors, keep)
            f, e = f + ff, e + ee
            offsets.append(len(f))
        c = S.line_codes(np.array(f, np.int64), np.array(e, np.int64) if detectors else None, np.array(offsets), detectors, sum(d[0] for d in detectors), keep, 0)
        got = [None if f[i] & S.TRUE_BLANK else (int(c[i] & 3), bool(c[i] & S.COMMENT), bool(c[i] & S.CHANGE)) for i in range(len(f))]
        assert got == want
