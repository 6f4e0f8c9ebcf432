"""Sets by phases against a plain greedy walk over all tracks of a group."""

import random

import pytest

from lakeshelf.operators import mixing

PHASES = {"warmup": (("Chill", "Mid"), 100, 125), "build": (("Mid", "Peak"), 118, 130), "peak": (("Peak",), 124, 150), "release": (("Mid", "Chill"), 110, 128), "outro": (("Chill", "Mid"), 95, 125)}


def plain_set(rows, times, jump, window):
    """[(phase, id)]; rows: (id, artist, title, bpm, key, seconds), energies by tempo alone."""

    def fit(r, phase):
        energies, low, high = PHASES[phase]
        energy = "Peak" if r[3] >= 126 else "Mid" if r[3] >= 118 else "Chill"
        return 0.5 * (energy in energies) + (0.5 if low <= r[3] <= high else max(0.0, 0.3 - min(abs(r[3] - low), abs(r[3] - high)) / 100))

    def wheel(a, b):
        d = abs(int(a[:-1]) - int(b[:-1]))
        return min(d, 12 - d), a[-1] == b[-1]

    def score(a, b, artists):
        d, same = wheel(a[4], b[4])
        key = {0: (0.85, 1.0), 1: (0.8, 0.9), 2: (0.45, 0.55), 3: (0.25, 0.25)}.get(d, (0.1, 0.1))[same]
        off = min(abs(b[3] / a[3] * k - 1) for k in (1, 2, 0.5))
        tempo = next((s for most, s in ((0.02, 0.95), (0.05, 0.82), (0.08, 0.65), (0.12, 0.45), (0.2, 0.25)) if off <= most), 0.1)
        step = abs(b[3] - a[3])
        cut = 1.0 if step <= 3 else round(1 - 0.6 * (step - 3) / 3, 3) if step <= 6 else 0.1
        return round((0.55 * key + 0.45 * tempo) * cut * (0.35 if b[1] in artists else 1.0), 9)

    chosen = []
    for phase, seconds in times:
        played = 0.0
        while played < seconds:
            artists = [r[1] for _, r in chosen]
            left = [r for r in rows if all((r[1], r[2]) != (c[1], c[2]) for _, c in chosen)]
            if not left:
                return [(p, r[0]) for p, r in chosen]
            if chosen:
                last = chosen[-1][1]

                def rung(r):
                    d, same = wheel(last[4], r[4])
                    near = abs(r[3] - last[3]) <= jump and (d == 0 or d == 1 and same)
                    return (0 if r[1] not in artists[-window:] else 1) if near else 2

                best = min(left, key=lambda r: (rung(r), -score(last, r, artists), -fit(r, phase), r[1], r[2], r[0]))
            else:
                best = min(left, key=lambda r: (-fit(r, phase), r[1], r[2], r[0]))
            chosen.append((phase, best))
            played += best[5]
    return [(p, r[0]) for p, r in chosen]


@pytest.mark.parametrize("vibe, structure", [("peak", "full"), ("warm", "simple")])
def test_sets_equal_a_plain_walk(spark, vibe, structure):
    numbers = random.Random(2)
    songs = {g: [(1000 * k + i, f"artist {numbers.randint(0, 9)}", f"song {k}x{i}", numbers.randint(95, 140) + 0.5 * numbers.randint(0, 1), f"{numbers.randint(1, 12)}{numbers.choice('AB')}", float(numbers.randint(200, 500))) for i in range(n)] for k, (g, n) in enumerate((("Techno", 120), ("Funk", 60), (None, 5)))}
    rows = [(*r, g, "ok", f"/lib/{r[0]}.mp3") for g, of in songs.items() for r in of]
    rows += [(9001, "Unknown", "x", 120.0, "8A", 300.0, "Funk", "ok", "/lib/u.mp3"), (9002, "artist 1", "x DJ Tool", 120.0, "8A", 300.0, "Funk", "ok", "/lib/t.mp3"), (9003, "artist 1", "none", None, "8A", 300.0, "Funk", "ok", "/lib/n.mp3"), (9004, "artist 1", "gone", 120.0, "8A", 300.0, "Funk", "stale", "/lib/s.mp3")]
    tracks = spark.createDataFrame(rows, "id long, artist string, title string, bpm double, key_camelot string, duration_sec double, genre string, status string, filepath string")
    got = {}
    for r in mixing.phased_sets(tracks, "genre", 60, vibe, structure).orderBy("genre", "position").collect():
        got.setdefault(r["genre"], []).append((r["phase"], r["id"]))
    assert got == {g: plain_set(of, mixing.phase_times(vibe, structure, 60), 3.0, 3) for g, of in songs.items()}


def test_no_tracks_no_sets(spark):
    empty = spark.createDataFrame([], "id long, artist string, title string, bpm double, key_camelot string, duration_sec double, genre string, status string, filepath string")
    assert mixing.phased_sets(empty, "genre").collect() == []
    with pytest.raises(ValueError):
        mixing.phased_sets(empty, "genre", vibe="nope")
