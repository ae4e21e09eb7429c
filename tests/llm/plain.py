"""Toxicity scores in plain Python: each token against every term by edit distance, no trie and no automaton."""

import numpy as np

from pagelathe.llm import toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def kind(token, m):
    w = token.lower()
    while w and not w[0].isalnum():
        w = w[1:]
    while w and not w[-1].isalnum():
        w = w[:-1]
    if w in m.words:
        return "word", w
    begun = sorted((p for p in m.prefixes if w.startswith(p)), key=len)
    if begun:
        return "prefix", begun[0]
    near = [(edits(w, t), t) for t in m.words if abs(len(w) - len(t)) <= 2 and w]
    near = [x for x in near if x[0] <= (0 if len(x[1]) < 5 else 1 if len(x[1]) < 9 else 2)]
    return ("fuzzy", min(near)[1]) if near else None


def plain_score(text, m, kinds):
    """kinds: what earlier calls found out about tokens."""
    tokens = (text or "").split()
    exact, fuzzy = {}, 0.0
    for i, t in enumerate(tokens):
        if t not in kinds:
            kinds[t] = kind(t, m)
        if kinds[t]:
            what, term = kinds[t]
            before, behind = tokens[max(0, i - 6) : i], tokens[i + 1 : i + 7]
            near = [toxicity.strip_word(x) for x in before + behind]
            bare = [x.rstrip(".,;:!?") for x in [t, *behind]]
            opens, closes = any(x[0] in toxicity.QUOTES for x in [t, *before]), any(x and x[-1] in toxicity.QUOTES for x in bare)
            w = {"word": m.words.get(term, 0.0), "prefix": m.prefixes.get(term, 0.0), "fuzzy": min(m.words.get(term, 0.0), m.fuzzy.get(term, 0.0))}[what]
            w *= m.quoted[what] if (opens and closes) or any(x in m.reporting for x in near) else 1
            w += max(-1.0, min(1.0, sum(m.context.get(x, 0.0) for x in near)))
            if what == "fuzzy":
                fuzzy = max(fuzzy, w)
            else:
                exact[term] = max(exact.get(term, -9.0), w)
    z = m.prior + fuzzy + sum(w / 2**i for i, w in enumerate(sorted(exact.values(), reverse=True))) if exact or fuzzy > 0 else m.base
    return 1 / (1 + np.exp(-max(-30, min(30, z))))
