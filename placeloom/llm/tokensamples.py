"""Labelled samples of long tokens: random strings as keys are written, and ordinary identifiers, paths, file names and numbers.

The samples are made by rule from a seed. `fit` in secrets.py trains on one seed and every other word, and sets its threshold on another seed and
the words left out.
"""

from __future__ import annotations

import base64
import random
import string

# Common words of names in programs, paths and addresses.
WORDS = (
    "account action active address album alpha analysis archive article asset author backup base beta bill block board book branch browser bucket budget build button cache calendar "
    "camera card catalog center change channel chapter charge chart check child class client cloud code column comment common company config connect content control convert cookie copy "
    "core count country course create current custom daily data date debug default delete delivery demo design detail device digital direct display document domain download driver edit "
    "element email engine entry error event example export factory feature field file filter final find first folder form frame function gallery general get global graph group guide handle "
    "header health history home host image import index info input install interface invoice issue item journal key language large last layout left level library license limit line link list "
    "load local login machine main manager market master media member memory message method mobile model module month name network news node note number object office order package page "
    "parent path payment person phone photo picture place plan platform player point policy post press price print private process product profile project property public question"
).split()

ACRONYMS = "API CPU CSV DNS GPU HTML IO JSON JWT SDK SQL SSH TCP UI URI XML".split()

ALPHABETS = (
    string.ascii_letters + string.digits, string.ascii_letters + string.digits + "-_", string.ascii_uppercase + string.digits, string.ascii_uppercase + "234567",
    string.ascii_lowercase + string.digits, string.ascii_letters, string.digits + "ABCDEF")


def random_tokens(seed: int, n: int) -> list[str]:
    rng, out = random.Random(seed), []
    for i in range(n):
        length = rng.randint(16, 48)
        if i % 8 == 7:
            out.append(base64.b64encode(rng.randbytes(length * 3 // 4)).decode())
        else:
            out.append("".join(rng.choice(ALPHABETS[i % 8]) for _ in range(length)))
    return out


def ordinary_tokens(seed: int, n: int, known: list[str]) -> list[str]:
    rng, out = random.Random(seed), []
    number = lambda: str(rng.randrange(10 ** rng.randint(1, 4)))
    while len(out) < n:
        words = rng.choices(known, k=rng.randint(3, 7))
        if rng.random() < 0.4:
            words.insert(rng.randint(1, len(words)), number())
        cased = [rng.choice(ACRONYMS) if rng.random() < 0.15 else w.capitalize() for w in words]
        glue = rng.choice("_-/")
        kind = rng.randrange(9)
        if kind == 0:
            token = words[0] + "".join(cased[1:])
        elif kind == 1:
            token = "".join(cased)
        elif kind == 2:
            token = glue.join(words).upper()
        elif kind == 3:
            token = "/" + "/".join(rng.choice(("", w)) + rng.choice("_-").join(rng.choices(known, k=2)) for w in words)
        elif kind == 4:
            token = "/".join(words[:-1]) + "/" + "".join(w.capitalize() for w in rng.choices(known, k=3))
        elif kind == 5:
            token = "-".join(words) + f"-{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}" + rng.choice(("", f"T{rng.randint(0, 235959):06}Z"))
        elif kind == 6:
            token = f"/{rng.randint(1990, 2030)}/{rng.randint(1, 12):02}/{rng.randint(1, 28):02}/" + "-".join(words)
        elif kind == 7:
            token = "".join(words)
        else:
            token = glue.join(w + rng.choice(("", "", number())) for w in words)
        if rng.random() < 0.15:
            token += rng.choice(("", "_", "-")) + rng.choice("vV") + str(rng.randint(1, 20))
        if len(token) >= 16:
            out.append(token)
    return out
