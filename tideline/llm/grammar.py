"""A weighted pattern grammar of sequential transducers over classes of words.

Each transducer reads a stream of symbols and writes one for each that it reads; a symbol is a class
with marks that earlier transducers put behind it. `composed` chains them and compiles the product of
their reachable states into one table, so that a text costs one step a token however many there are.

Classes: I an insult, T a threatening verb that takes an object, X one that takes none, V one that does so at the end of a clause alone, W what announces
a threat, Y somebody else as a target, Z the reflexive target, S the speaker, N a negation, R a verb that
reports, Q a quotation mark, c a comma, # the end of a clause, P the end of a paragraph, o any other word.
Marks: r reported, n negated, d directed at somebody else, s at the speaker. K is a complete threat; D says
that the insult before it turns out to be directed.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable

CLASSES = "ITXVWYZSNRQc#Po"

Step = Callable[[Hashable, str], tuple[Hashable, str]]

#: The words after a negation, and after a threatening verb, within which it holds.
SCOPE = 3


def reported(state: str, x: str) -> tuple[str, str]:
    """Marks what stands in quotation marks, or behind a verb that reports until the clause ends."""
    if x == "P":
        return "", x
    if x == "Q":
        return ("" if state == "quoted" else "quoted"), x
    if x == "#" and state == "said" or x == "R" and not state:
        return ("said" if x == "R" else ""), x
    return state, x + "r" if state and x[0] in "ITXV" else x


def negated(state: int, x: str) -> tuple[int, str]:
    """Marks what follows a negation within a few words of the same clause."""
    if x == "N":
        return SCOPE, x
    if x in "#Pc":
        return 0, x
    return max(state - 1, 0), x + "n" if state and x[0] in "ITXV" else x


def targeted(state: str, x: str) -> tuple[str, str]:
    """Marks insults whose clause names a target before them; a target behind one becomes D."""
    if x in "#P":
        return "", x
    if x[0] in "YZ":
        return "other", "D" if state == "insult" else x
    if x == "S":
        return state or "self", x
    if x[0] == "I":
        return state or ("insult" if x == "I" else ""), x + {"other": "d", "self": "s"}.get(state, "")
    return state, x


Threat = tuple[str, bool, int, str, bool]


def threatening(state: Threat, x: str) -> tuple[Threat, str]:
    """Writes K where an announced verb meets a target: will T Y, T Z, and Y will X in either order. State: announced, target, words left, marks, whether V waits for the end."""
    announced, target, left, marks, waits = state
    if x in "#P":
        return ("", False, 0, "", False), "K" + marks if waits and announced and target else x
    if x == "W":
        return ("W", target, left, "" if waits else marks, False), x
    if x[0] == "V":
        return (announced, target, 0, x[1:], True), "o"
    if x[0] == "T":
        return (announced, target, SCOPE, x[1:], False), "o"
    if x[0] == "X":
        return (announced, target, 0, "", False), "K" + x[1:] if announced and target else "o"
    if x[0] in "YZD":
        hit = left and (announced or x[0] == "Z")
        return (announced, True, 0, "", False), "K" + marks if hit else x
    return (announced, target, max(left - 1, 0), marks if left > 1 and not waits else "", False), x


#: The cascade, and the state that each begins in.
CASCADE: list[tuple[Step, Hashable]] = [(reported, ""), (negated, 0), (targeted, ""), (threatening, ("", False, 0, "", False))]


def label(x: str) -> str | None:
    """What a written symbol says about its clause."""
    if x[0] not in "IKD":
        return None
    if x == "D":
        return "directed"
    if "r" in x:
        return "reported"
    if "n" in x:
        return "negated"
    if x[0] == "K":
        return "threat"
    return "directed" if "d" in x else "self" if "s" in x else "insult"


def composed(cascade: list[tuple[Step, Hashable]] = CASCADE, classes: str = CLASSES) -> tuple[list[list[int]], list[list[str | None]]]:
    """The product of the cascade: by state and class the next state, and the label written. State 0 is the first."""
    start = tuple(s for _, s in cascade)
    number, order = {start: 0}, [start]
    follows: list[list[int]] = []
    writes: list[list[str | None]] = []
    for states in order:  # grows while it is read
        after, out = [], []
        for x in classes:
            new = []
            for (step, _), state in zip(cascade, states, strict=True):
                state, x = step(state, x)
                new.append(state)
            if (key := tuple(new)) not in number:
                number[key] = len(order)
                order.append(key)
            after.append(number[key])
            out.append(label(x))
        follows.append(after)
        writes.append(out)
    return follows, writes
