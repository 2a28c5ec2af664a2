"""What ordinary text gives in the randomness battery, by alphabet and length.

``ordinary`` writes runs as people and programs do: words of several languages, in
lower, upper or camel case, with numbers, dates and counters between them and marks
where the alphabet has some. ``calibrated`` puts many of them through the battery;
``NULLS`` holds its results, so workers need not simulate. For each alphabet and
length: mean and deviation of the three scores, then the deviation of their weighted
sum: the largest of its standard one and those its lowest hundredth and thousandth ask for.
"""

from __future__ import annotations

import math
import random

import numpy as np

LENGTHS = (20, 24, 28, 32, 40, 48, 64, 96, 128)
WORDS = """the of and to in is that for was with his they this have from one word but what some when out other were all your
can said there use each which she how their will way about many then them write would like these her long make thing see him two has look
more day could come did number sound most people over know water than call first who may down side been now find any new work part take get
place made live where after back little only round man year came show every good give our under name very through just form sentence great
think help low line differ turn cause much mean before move right boy old too same tell does set three want air well also play small end put
home read hand port large spell add even land here must big high such follow act why ask men change went light kind off need house picture try
user data file path list index error value string object request response config service handler manager test build version update delete
create client server session cache query table column image report backup release module package default global system process thread
und der die das nicht ein eine einheit heit keit lich schaft ung sch ch pf tz st cht stsch schl pfl er be ge zu ver au eu zwischen ver ent schule bericht
le les des une dans pour pas sur avec est tion ment elle nous vous rapport fichier
que los las una con por para como pero sus este entre todo desde cuando archivo informe
dead beef cafe face fade bad bed cab dab deed feed fee add ace babe decade facade ab cd ef""".split()


def _number(rng: random.Random) -> str:
    kind = rng.random()
    if kind < 0.25:
        return str(rng.randint(0, 9))
    if kind < 0.45:
        return str(rng.randint(1950, 2035))
    if kind < 0.6:
        return f"{rng.randint(1990, 2035)}{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}"
    return str(rng.randint(10, 10 ** rng.randint(2, 7))).zfill(rng.choice((1, 3, 4)))


def ordinary(rng: random.Random, n: int, alphabet: str) -> str:
    """A run of n characters of an alphabet as ordinary text has them."""
    have = set(alphabet)
    lower, upper, digits = "a" in have, "A" in have, "2" in have
    words = [w for w in WORDS if not lower and set(w.upper()) <= have or lower and set(w) <= have]
    marks = [c for c in "/+-_" if c in have]
    style = rng.choice(["lower", "camel", "camel", "upper"] if lower and upper else ["lower" if lower else "upper"])
    mark = rng.choice([*marks, ""]) if marks else ""
    share = rng.choice((0.1, 0.25, 0.4)) if digits and words else 1.0 if digits else 0.0
    out = ""
    while len(out) < n:
        if rng.random() < share:
            piece = "".join(c for c in _number(rng) if c in have)
        else:
            w = rng.choice(words)
            piece = w.upper() if style == "upper" or (style == "camel" and rng.random() < 0.1) else w.capitalize() if style == "camel" else w
        out += (mark if out else "") + piece
    at = rng.randint(0, len(out) - n)
    return out[at : at + n]


def calibrated(name: str, n: int, draws: int = 4000, seed: int = 7) -> tuple[float, ...]:
    """The numbers of NULLS for an alphabet and a length."""
    from . import secrets

    rng = random.Random(f"{seed} {name} {n}")
    scores = np.array([secrets.battery(ordinary(rng, n, secrets.ALPHABETS[name]), name) for _ in range(draws)])
    mean, deviation = scores.mean(0), np.maximum(scores.std(0), 0.3)
    z = ((scores - mean) / deviation) @ np.array(secrets.WEIGHTS)
    spread = max(float(z.std()), *(-float(np.quantile(z, q)) / t for q, t in ((0.01, 2.326), (0.001, 3.09))))
    return tuple(round(float(x), 2) for x in (*np.stack([mean, deviation], 1).ravel(), spread))


def null_of(name: str, n: int) -> list[float]:
    """The numbers for any length, between the two nearest of LENGTHS; longer runs take the last, which errs to the safe side."""
    rows = NULLS[name]
    return [float(np.interp(math.log(n), np.log(LENGTHS), [r[i] for r in rows])) for i in range(7)]


NULLS: dict[str, tuple[tuple[float, ...], ...]] = {
    "digits": ((0.73, 1.16, 0.97, 0.73, 0.74, 0.55, 2.22), (0.75, 1.17, 0.98, 0.73, 0.76, 0.56, 2.24), (0.89, 1.21, 1.0, 0.74, 0.76, 0.56, 2.24), (0.98, 1.25, 1.05, 0.77, 0.79, 0.59, 2.25), (1.19, 1.29, 1.08, 0.78, 0.79, 0.59, 2.26), (1.36, 1.29, 1.11, 0.79, 0.82, 0.59, 2.29), (1.74, 1.32, 1.2, 0.85, 0.87, 0.64, 2.29), (2.35, 1.37, 1.33, 0.87, 0.96, 0.68, 2.3), (2.95, 1.37, 1.49, 0.91, 1.05, 0.71, 2.32)),
    "lower26": ((1.36, 1.16, 2.49, 0.77, 0.79, 0.57, 2.04), (1.67, 1.16, 2.72, 0.76, 0.8, 0.6, 2.08), (1.96, 1.15, 2.95, 0.77, 0.8, 0.59, 2.08), (2.24, 1.18, 3.14, 0.75, 0.82, 0.61, 2.08), (2.76, 1.17, 3.54, 0.76, 0.81, 0.61, 2.07), (3.27, 1.2, 3.87, 0.77, 0.84, 0.61, 2.1), (4.17, 1.2, 4.49, 0.75, 0.82, 0.61, 2.06), (5.65, 1.16, 5.48, 0.76, 0.84, 0.63, 2.08), (6.93, 1.14, 6.34, 0.76, 0.86, 0.65, 2.1)),
    "upper26": ((1.37, 1.14, 2.44, 0.74, 0.8, 0.59, 2.05), (1.68, 1.16, 2.68, 0.74, 0.8, 0.58, 2.04), (1.97, 1.17, 2.89, 0.74, 0.79, 0.6, 2.08), (2.26, 1.2, 3.1, 0.75, 0.81, 0.6, 2.09), (2.74, 1.18, 3.47, 0.75, 0.82, 0.61, 2.07), (3.25, 1.18, 3.83, 0.76, 0.82, 0.62, 2.09), (4.1, 1.18, 4.41, 0.74, 0.83, 0.61, 2.07), (5.65, 1.16, 5.4, 0.75, 0.82, 0.63, 2.08), (6.87, 1.12, 6.23, 0.75, 0.86, 0.65, 2.08)),
    "hex_lower": ((2.15, 1.72, 3.1, 0.56, 1.61, 0.99, 2.16), (2.46, 1.87, 3.41, 0.58, 1.89, 1.09, 2.16), (2.77, 1.97, 3.68, 0.6, 2.13, 1.15, 2.11), (3.12, 2.06, 3.94, 0.61, 2.35, 1.22, 2.11), (3.66, 2.2, 4.42, 0.64, 2.79, 1.31, 2.14), (4.15, 2.36, 4.83, 0.67, 3.16, 1.35, 2.15), (5.02, 2.58, 5.58, 0.7, 3.88, 1.41, 2.18), (6.42, 2.87, 6.82, 0.78, 5.06, 1.39, 2.26), (7.73, 3.21, 7.88, 0.87, 5.92, 1.44, 2.26)),
    "hex_upper": ((2.2, 1.72, 3.15, 0.58, 1.59, 0.98, 2.18), (2.52, 1.84, 3.46, 0.58, 1.87, 1.08, 2.13), (2.83, 1.94, 3.74, 0.6, 2.13, 1.17, 2.14), (3.1, 2.03, 4.0, 0.62, 2.36, 1.22, 2.12), (3.62, 2.2, 4.46, 0.64, 2.78, 1.32, 2.13), (4.08, 2.34, 4.89, 0.67, 3.19, 1.35, 2.15), (5.0, 2.6, 5.66, 0.72, 3.87, 1.41, 2.19), (6.47, 2.87, 6.92, 0.79, 5.03, 1.38, 2.25), (7.65, 3.21, 7.99, 0.86, 5.95, 1.42, 2.26)),
    "base32": ((1.47, 1.27, 1.69, 0.57, 1.26, 0.82, 2.04), (1.82, 1.28, 1.87, 0.59, 1.34, 0.89, 1.98), (2.02, 1.32, 2.0, 0.62, 1.46, 0.94, 1.89), (2.29, 1.3, 2.14, 0.62, 1.56, 1.0, 1.97), (2.75, 1.37, 2.4, 0.65, 1.75, 1.07, 1.92), (3.22, 1.39, 2.63, 0.68, 1.96, 1.16, 1.93), (4.05, 1.43, 3.04, 0.74, 2.28, 1.27, 1.92), (5.51, 1.52, 3.72, 0.83, 2.84, 1.47, 1.91), (6.75, 1.59, 4.31, 0.92, 3.33, 1.59, 1.92)),
    "lower36": ((1.61, 1.42, 2.5, 0.51, 1.42, 0.88, 2.19), (1.88, 1.42, 2.76, 0.52, 1.56, 0.95, 2.04), (2.12, 1.47, 2.98, 0.54, 1.73, 1.01, 2.13), (2.34, 1.49, 3.17, 0.55, 1.91, 1.06, 1.96), (2.82, 1.56, 3.58, 0.57, 2.16, 1.17, 2.01), (3.19, 1.59, 3.9, 0.58, 2.45, 1.25, 1.96), (3.99, 1.65, 4.52, 0.62, 2.86, 1.34, 1.96), (5.32, 1.76, 5.5, 0.71, 3.64, 1.51, 1.98), (6.53, 1.87, 6.36, 0.77, 4.31, 1.62, 1.96)),
    "upper36": ((1.62, 1.41, 2.48, 0.5, 1.43, 0.87, 1.98), (1.86, 1.39, 2.73, 0.53, 1.59, 0.96, 2.08), (2.1, 1.44, 2.95, 0.52, 1.77, 1.02, 2.18), (2.35, 1.5, 3.15, 0.54, 1.89, 1.06, 2.01), (2.78, 1.54, 3.51, 0.56, 2.19, 1.17, 2.03), (3.2, 1.57, 3.86, 0.59, 2.41, 1.24, 1.96), (3.96, 1.65, 4.46, 0.63, 2.89, 1.37, 1.95), (5.36, 1.75, 5.45, 0.69, 3.7, 1.52, 1.95), (6.56, 1.87, 6.31, 0.76, 4.31, 1.65, 1.97)),
    "letters52": ((2.53, 1.6, 2.29, 0.43, 0.86, 0.59, 2.63), (2.98, 1.65, 2.52, 0.45, 0.91, 0.62, 2.64), (3.43, 1.78, 2.73, 0.46, 0.9, 0.62, 2.68), (3.93, 1.84, 2.94, 0.47, 0.92, 0.64, 2.65), (4.76, 1.98, 3.28, 0.51, 0.93, 0.66, 2.6), (5.51, 2.07, 3.62, 0.5, 0.94, 0.68, 2.5), (6.94, 2.29, 4.18, 0.55, 0.94, 0.69, 2.5), (9.13, 2.65, 5.11, 0.63, 0.99, 0.74, 2.32), (11.13, 2.92, 5.9, 0.7, 0.99, 0.74, 2.33)),
    "base62": ((2.48, 1.76, 2.88, 0.54, 1.59, 0.98, 2.09), (2.86, 1.76, 3.15, 0.56, 1.77, 1.07, 2.07), (3.28, 1.83, 3.42, 0.57, 1.99, 1.2, 2.09), (3.68, 1.89, 3.65, 0.58, 2.16, 1.28, 2.07), (4.29, 2.01, 4.06, 0.61, 2.48, 1.4, 2.07), (4.91, 2.07, 4.47, 0.62, 2.81, 1.5, 2.11), (6.08, 2.24, 5.17, 0.67, 3.27, 1.68, 2.16), (8.11, 2.5, 6.33, 0.72, 4.18, 1.96, 2.21), (9.81, 2.69, 7.3, 0.8, 4.92, 2.16, 2.27)),
    "base64": ((3.15, 1.57, 2.87, 0.5, 1.25, 0.84, 2.06), (3.78, 1.61, 3.16, 0.51, 1.38, 0.94, 2.17), (4.29, 1.72, 3.4, 0.52, 1.51, 1.03, 2.1), (4.88, 1.74, 3.63, 0.54, 1.58, 1.08, 2.11), (5.9, 1.93, 4.07, 0.56, 1.74, 1.22, 2.2), (6.81, 2.07, 4.46, 0.59, 1.89, 1.32, 2.16), (8.47, 2.34, 5.15, 0.61, 2.23, 1.57, 2.27), (11.28, 2.76, 6.32, 0.68, 2.7, 1.89, 2.26), (13.59, 3.19, 7.29, 0.74, 3.16, 2.2, 2.12)),
    "base64url": ((3.13, 1.56, 2.89, 0.5, 1.26, 0.85, 2.1), (3.69, 1.62, 3.17, 0.52, 1.4, 0.93, 2.14), (4.3, 1.72, 3.43, 0.53, 1.49, 1.03, 2.29), (4.87, 1.75, 3.66, 0.54, 1.58, 1.08, 2.22), (5.89, 1.93, 4.1, 0.57, 1.79, 1.24, 2.18), (6.78, 2.1, 4.49, 0.59, 1.96, 1.36, 2.18), (8.53, 2.28, 5.19, 0.61, 2.24, 1.58, 2.16), (11.29, 2.75, 6.35, 0.68, 2.67, 1.86, 2.2), (13.63, 3.12, 7.37, 0.73, 3.09, 2.22, 2.18)),
}
