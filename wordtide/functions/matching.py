"""Many phrases found in a text in one pass, by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator


def is_word(c: str) -> bool:
    """Whether a character belongs to a word."""
    return c.isalnum() or c == "_"


class Phrases:
    """An automaton over phrases; built once, it reads each text once, however many phrases there are."""

    def __init__(self, phrases: list[str]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p in phrases:
            if p:
                self.automaton.add_word(p, p)
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def found(self, text: str, bounded: bool = False) -> Iterator[tuple[int, str]]:
        """Start and phrase of every occurrence, in order of their ends, overlapping ones too; ``bounded``: both ends at a word's
        bound, which is where exactly one of two neighbours belongs to a word."""
        if not self.any:
            return
        n = len(text)
        for last, phrase in self.automaton.iter(text):
            start, end = last + 1 - len(phrase), last + 1
            if bounded and ((start > 0 and is_word(text[start - 1])) == is_word(phrase[0]) or (end < n and is_word(text[end])) == is_word(phrase[-1])):
                continue
            yield start, phrase

    def counts(self, text: str) -> dict[str, int]:
        """For each phrase its bounded occurrences that don't overlap each other, taken from the left."""
        out: dict[str, int] = {}
        until: dict[str, int] = {}
        for start, phrase in self.found(text, bounded=True):
            if start >= until.get(phrase, 0):
                out[phrase] = out.get(phrase, 0) + 1
                until[phrase] = start + len(phrase)
        return out
