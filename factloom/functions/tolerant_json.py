"""JSON that was cut or decorated: what is whole of it, and counts of what is not."""

from __future__ import annotations

import re

_TOKEN = re.compile(r'\s+|"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+|"', re.DOTALL)
_SCALAR = re.compile(r"(?:true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)\Z")
_CLOSES = {"{": "}", "[": "]"}

Repaired = tuple[str | None, int, int, int]


def repair(text: str) -> Repaired:
    """The JSON value that text holds, whole; how many brackets were closed for it, how many commas dropped and how many characters cut off.

    What stands before the first bracket and behind the value is cut. The automaton's state is what may come next within the
    open brackets: where a text breaks off, or something else comes, it is cut behind the last element or member that was
    whole, and the brackets around that are closed. An element of a list is whole or goes, with all that it holds.
    A comma before a closing bracket, and one without anything before it, is dropped. Without any bracket the value is None.
    """
    starts = [k for k in (text.find("{"), text.find("[")) if k >= 0]
    if not starts:
        return None, 0, 0, len(text)
    begin = min(starts)
    stack: list[str] = []
    out: list[str] = []
    # After what is whole: how many pieces of out, which brackets are open, and where it ends in text.
    safe, open_then, end = 0, "", begin
    # `key`: a member's name or an end may come; `name`: its name must, after a comma; `colon`, `value`; `next`: a comma or an end; `first`: a list's first element or end.
    state, commas, pending = "value", 0, False
    for m in _TOKEN.finditer(text, begin):
        t = m[0]
        if t.isspace():
            continue
        if t == "," and state in ("next", "key", "first", "name", "element"):
            commas += pending or state in ("key", "first")
            pending = state not in ("key", "first")
            state = state if state in ("key", "first") else ("name" if stack[-1] == "{" else "element")
            continue
        closing = t in "}]" and len(t) == 1 and stack and t == _CLOSES[stack[-1]] and state in ("key", "name", "next", "first", "element")
        opening = t in "{[" and state in ("value", "first", "element")
        string = len(t) > 1 and t[0] == '"'
        scalar = state in ("value", "first", "element") and (string or _SCALAR.match(t))
        named = string and state in ("key", "name")
        if not (closing or opening or scalar or named or (t == ":" and state == "colon")):
            break
        if pending and closing:
            commas += 1
        elif pending:
            out.append(",")
        pending = False
        out.append(t)
        if opening:
            stack.append(t)
            state = "key" if t == "{" else "first"
        elif named:
            state = "colon"
        elif t == ":" and state == "colon":
            state = "value"
        else:
            if closing:
                stack.pop()
            state = "next"
        # A list's element counts once it is whole itself: what is open around it may be one list, within objects.
        if state != "colon" and (state != "value") and "[" not in stack[:-1] and (not opening or len(stack) == 1 or "[" not in stack):
            safe, open_then, end = len(out), "".join(stack), m.end()
        if closing and not stack:
            break
    closed = "".join(_CLOSES[b] for b in reversed(open_then))
    return "".join(out[:safe]) + closed, len(closed), commas, begin + len(text) - end
