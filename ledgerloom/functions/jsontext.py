"""Reading JSON as a stream of events, to any depth.

The reader goes through the text once, token by token, and keeps a stack of the
open objects and lists of its own, so that neither the depth nor the size of a
record is limited by anything but its text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

BLANKS = r"[ \t\n\r]*"
#: One value's beginning: an opening mark, a string without escapes, a string with escapes, a number or a constant.
VALUE = re.compile(BLANKS + r'(?:([\[{])|"([^"\\\x00-\x1f]*)"|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?(?![0-9]))|(true|false|null|NaN|-?Infinity))' + BLANKS)
KEY = re.compile(BLANKS + r'(?:"([^"\\\x00-\x1f]*)"|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*"))' + BLANKS + ":")
NEXT = re.compile(r"([,\]}])" + BLANKS)
END = re.compile(r"([\]}])" + BLANKS)

#: Kinds of events.
OPEN, CLOSE, KEY_EVENT, TEXT, OTHER = "open", "close", "key", "text", "other"


def events(text: str) -> Iterator[tuple[str, str]]:
    """(kind, content) of each part of a JSON text.

    open and close carry [ or {, key the key, text a string's content, other a number or constant as it is written.
    Raises ValueError where the text is not JSON.
    """
    at = 0
    stack: list[str] = []
    while True:
        m = VALUE.match(text, at)
        if m is None:
            raise ValueError(at)
        at = m.end()
        which = m.lastindex
        if which == 1:
            mark = m[1]
            yield OPEN, mark
            end = END.match(text, at)
            if end is None:
                stack.append(mark)
                if mark == "{":
                    k = KEY.match(text, at)
                    if k is None:
                        raise ValueError(at)
                    yield KEY_EVENT, k[1] if k[1] is not None else json.loads(k[2])
                    at = k.end()
                continue
            if (end[1] == "}") != (mark == "{"):
                raise ValueError(at)
            yield CLOSE, mark
            at = end.end()
        elif which == 2:
            yield TEXT, m[2]
        elif which == 3:
            yield TEXT, json.loads(m[3])
        else:
            yield OTHER, m[which]
        # A value has ended; what closes behind it ends too.
        while stack:
            n = NEXT.match(text, at)
            if n is None:
                raise ValueError(at)
            at = n.end()
            if n[1] == ",":
                if stack[-1] == "{":
                    k = KEY.match(text, at)
                    if k is None:
                        raise ValueError(at)
                    yield KEY_EVENT, k[1] if k[1] is not None else json.loads(k[2])
                    at = k.end()
                break
            if (n[1] == "}") != (stack[-1] == "{"):
                raise ValueError(at)
            yield CLOSE, stack.pop()
        else:
            if at != len(text):
                raise ValueError(at)
            return

