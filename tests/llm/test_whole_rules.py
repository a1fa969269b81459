"""Every alternative of every licence rule is found."""

import itertools
import re

from shelfmark.llm import licenses


def alternatives(expression):
    """Texts that match an expression of literals, groups of alternatives, optional parts and classes of characters."""
    out, at = [[""]], 0
    parts = [[]]
    while at < len(expression):
        if expression.startswith("(?:", at):
            depth, stop = 1, at + 3
            while depth:
                depth += {"(": 1, ")": -1}.get(expression[stop], 0)
                stop += 1
            made = alternatives(expression[at + 3 : stop - 1])
            at = stop
        elif expression[at] == "[":
            stop = expression.index("]", at) + 1
            made = [expression[at + 1], expression[stop - 2]]
            at = stop
        elif expression[at] == "|":
            parts.append([])
            at += 1
            continue
        else:
            made, at = [expression[at]], at + 1
        if at < len(expression) and expression[at] == "?":
            made, at = ["", *made], at + 1
        parts[-1].append(made)
    out = []
    for part in parts:
        sizes = 1
        for made in part:
            sizes *= len(made)
        if sizes <= 64:
            out += ["".join(x) for x in itertools.product(*part)]
        else:  # each alternative at least once, the others being first or last
            for n, made in enumerate(part):
                out += ["".join(x[k] if m != n else y for m, x in enumerate(part)) for y in made for k in (0, -1)]
    return list(dict.fromkeys(out))


def test_every_alternative_of_every_rule_is_found(spark):
    rules = licenses.rules()
    compiled = [re.compile(r[2]) for r in rules]
    given = sorted({" ".join(t.split()) for r in rules for t in alternatives(r[2])})
    assert len(given) > 2000 and {"expat license", "gpl2", "lgpl3", "apache2 license", "do what the fuck you want to public license"} <= set(given)
    assert "redistributions of source code must retain the above copyright" in given
    frame = spark.createDataFrame(list(enumerate(given)), "doc_id int, text string").repartition(8)
    found = {r.doc_id: r.detections for r in licenses.scan(frame).select("doc_id", "detections").collect()}
    lost = []
    for i, t in enumerate(given):
        label = next(r[0] for r, c in zip(rules, compiled) if c.fullmatch(t))
        first = found[i][0] if found[i] else None
        if first is None or (first.start, first.stop, first.label) != (0, len(t.split()), label):
            lost.append((t, label, first))
    assert not lost, (len(lost), lost[:5])
