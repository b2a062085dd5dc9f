"""Plain versions of the learned operators, one document and one letter at a time."""

import math
import zlib
from collections import defaultdict

import numpy as np

from memloom.llm import langid


def trigrams(text):
    low = "".join(c if c.isalpha() else "\0" for c in f" {(text or '').lower()} ")
    squeezed = [c for c, before in zip(low, "x" + low) if c != "\0" or before != "\0"]
    return [tuple(squeezed[i - 1 : i + 2]) for i in range(1, len(squeezed) - 1) if squeezed[i] != "\0"]


def bundled(text, dims=langid.DIMS):
    counts = defaultdict(int)
    for gram in trigrams(text):
        counts[gram] += 1
    total = np.zeros(dims)
    for gram, n in counts.items():
        a, b, c = (langid.letter(0 if x == "\0" else ord(x), dims).astype(float) for x in gram)
        total += n * np.roll(a, 2) * np.roll(b, 1) * c
    return total


def languages(rows):
    """``(language, cosine, trigrams)`` of each ``(id, text, lang)``, learned from those that are not held out."""
    protos = defaultdict(lambda: np.zeros(langid.DIMS))
    for i, text, lang in rows:
        if lang is not None and text is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2):
            protos[lang] += bundled(text)
    protos = {lang: v for lang, v in protos.items() if v.any()}
    out = []
    for _, text, _ in rows:
        v, n = bundled(text), len(trigrams(text))
        if not protos or not n:
            out.append(("und", 0.0, n))
            continue
        length = math.sqrt(v @ v) or 1.0
        cosine = {lang: v @ p / length / math.sqrt(p @ p) for lang, p in protos.items()}
        best = min(cosine, key=lambda lang: (-round(cosine[lang], 9), lang))
        out.append((best, min(1.0, max(0.0, cosine[best])), n))
    return out
