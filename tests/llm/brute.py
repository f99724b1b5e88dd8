"""Brute force that several tests share."""

import hashlib
from collections import Counter

import numpy as np


def removed_by_hand(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i] += 1
                gone[min(i + 200, len(d))] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(d, np.uint8)[~gone]) if len(d) else b""
        out.append((len(d), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
