"""Node-set expressions: names, @all @sources @sinks @nodes @pipes, + - and parentheses."""

from __future__ import annotations

import re

from millrace.plans.model import DefinitionError, ProcessDef

TOKEN = re.compile(r"\s*(@?[A-Za-z][\w:\-]*|[+\-()])")


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise DefinitionError(f"node set {text!r}: unexpected {text[at:]!r}")
        out.append(m[1])
        at = m.end()
    return out


def evaluate(text: str, sets: dict[str, list[str]], right_associative: bool = False) -> list[str]:
    """Members in the order of sets['@all']."""
    rest = tokens(text)

    def term() -> set[str]:
        if not rest:
            raise DefinitionError(f"node set {text!r} ends too early")
        t = rest.pop(0)
        if t == "(":
            got = expression()
            if not rest or rest.pop(0) != ")":
                raise DefinitionError(f"node set {text!r}: a parenthesis is open")
            return got
        if t in sets:
            return set(sets[t])
        if t in sets["@all"]:
            return {t}
        raise DefinitionError(f"node set {text!r}: no element {t!r}")

    def expression() -> set[str]:
        left = term()
        while rest and rest[0] in "+-":
            op = rest.pop(0)
            right = expression() if right_associative else term()
            left = left | right if op == "+" else left - right
        return left

    got = expression()
    if rest:
        raise DefinitionError(f"node set {text!r}: unexpected {rest[0]!r}")
    return [x for x in sets["@all"] if x in got]


def element_sets(p: ProcessDef) -> dict[str, list[str]]:
    sources, sinks = [t.name for t in p.inputs], [t.name for t in p.outputs]
    nodes, pipes = [n.name for n in p.nodes], [x.name for x in p.pipes]
    return {"@all": sources + nodes + pipes + sinks, "@sources": sources + pipes, "@sinks": sinks, "@nodes": nodes, "@pipes": pipes}
