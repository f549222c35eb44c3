"""Many phrases found in one reading of a text.

The words of the phrases form a trie with failure links, so a text is read once, word by word, whatever the number
of phrases; from the longest suffix of what was read that begins a phrase, the links of outputs lead to all phrases
that end there. Words are runs of ASCII letters, digits and underscores in lower case. A phrase that stands in a text
within the bounds of its pattern has its words there in a row, so none is missed; what stands between the words, and
around them, is the pattern's business.
"""

from __future__ import annotations

import re
from collections import deque
from functools import lru_cache

WORDS = re.compile(r"[a-z0-9_]+")
#: Bytes of a text as words are read from them: letters in lower case, blanks for all that is no part of a word.
LOWERED = bytes(ord(chr(b).lower()) if chr(b).isascii() and (chr(b).isalnum() or b == 95) else 32 for b in range(256))


@lru_cache(4)
def ascii_words(text: str) -> tuple[list[bytes], frozenset[bytes]]:
    """The ASCII words of a text in lower case, without a step of Python for each, and which they are. Those of the
    last texts are kept, as dictionaries and others ask for them in turn."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWERED).split()
    return words, frozenset(words)


class PhraseAutomaton:
    """Phrases by their place in a list of priorities, first come first."""

    def __init__(self, phrases: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        ends: list[list[int]] = [[]]
        #: Phrases without any word are in no trie; they are always to be looked for.
        self.always = [i for i, p in enumerate(phrases) if not WORDS.search(p.lower())]
        for i, phrase in enumerate(phrases):
            state = 0
            for word in WORDS.findall(phrase.lower()):
                if word not in self.arcs[state]:
                    self.arcs[state][word] = len(self.arcs)
                    self.arcs.append({})
                    ends.append([])
                state = self.arcs[state][word]
            if state:
                ends[state].append(i)
        self.fail = [0] * len(self.arcs)
        waiting = deque(self.arcs[0].values())
        while waiting:  # breadth first, so that shorter suffixes are ready
            state = waiting.popleft()
            for word, to in self.arcs[state].items():
                back = self.fail[state]
                while back and word not in self.arcs[back]:
                    back = self.fail[back]
                self.fail[to] = self.arcs[back].get(word, 0)
                waiting.append(to)
            ends[state] = ends[state] + ends[self.fail[state]]
        self.ends = [tuple(e) for e in ends]
        #: By its longest word, the place of each phrase, and its words between blanks if it has several.
        self.keys: dict[bytes, list[tuple[int, bytes | None]]] = {}
        for i, phrase in enumerate(phrases):
            if words := ascii_words(phrase)[0]:
                self.keys.setdefault(max(words, key=len), []).append((i, b" %b " % b" ".join(words) if len(words) > 1 else None))

    def present(self, low: str) -> set[int]:
        """Places of the phrases whose words a text in lower case has in a row."""
        arcs, fail, ends = self.arcs, self.fail, self.ends
        found, state = set(self.always), 0
        for word in WORDS.findall(low):
            to = arcs[state].get(word)
            while to is None and state:
                state = fail[state]
                to = arcs[state].get(word)
            state = to or 0
            if state and ends[state]:
                found.update(ends[state])
        return found

    def likely(self, text: str) -> list[int]:
        """Places, in order, of the phrases whose words a text has in a row: most texts have few of the words that the
        phrases are known by, and only phrases of those are looked for in the words as one string."""
        words, there = ascii_words(text)
        line, found = None, list(self.always)
        for word in self.keys.keys() & there:
            for i, phrase in self.keys[word]:
                if phrase:
                    line = line or b" %b " % b" ".join(words)
                    if phrase not in line:
                        continue
                found.append(i)
        return sorted(found)

    def in_turn(self, text: str, replace) -> str:
        """replace(i, text) for each phrase in the text, in order of priority, each on what the ones before it have
        left. A changed text is read again, as a replacement may make phrases that come later."""
        waiting = self.likely(text)
        while waiting:
            i = waiting.pop(0)
            after = replace(i, text)
            if after != text:
                text = after
                waiting = [k for k in self.likely(text) if k > i]
        return text
