"""Plain versions of repeats inside one sequence."""

from __future__ import annotations


def repeating_chunk(tokens: list[int], least: int = 2, most: int = 10) -> tuple[list[int], int]:
    """(chunk, k) of the least k in range for which the tokens are k copies of a chunk and a beginning of it; ([], -1) if none.

    For each k the longest chunk is tried first, down to the one whose rest would be as long as the chunk.
    """
    n = len(tokens)
    for k in range(least, most + 1):
        size = n // k
        while size > 0 and n - k * size < size:
            chunk = tokens[:size]
            if all(tokens[i] == chunk[i % size] for i in range(size, n)):
                return chunk, k
            size -= 1
    return [], -1


def _first_repeat(tokens: list[int], size: int) -> int | None:
    """Where the first sublist of a size begins that occurs again after its end."""
    first: dict[tuple[int, ...], int] = {}
    starts = [begin for at in range(len(tokens) - size + 1) if at - (begin := first.setdefault(tuple(tokens[at : at + size]), at)) >= size]
    return min(starts, default=None)


def longest_repeated_sublist(tokens: list[int]) -> list[int]:
    """The longest sublist that occurs again after its end; of several the one that begins first.

    If a size occurs twice, so does every smaller one, so the size is found by halving.
    """
    low, high = 0, len(tokens) // 2
    while low < high:
        size = (low + high + 1) // 2
        if _first_repeat(tokens, size) is None:
            high = size - 1
        else:
            low = size
    begin = _first_repeat(tokens, low) if low else 0
    return list(tokens[begin : begin + low])


def most_frequent_substring(text: str, least: int = 2) -> str | None:
    """The substring of at least two characters that str.count() finds most often; ties: the longest, then the first in order.

    No substring is found more often than a part of it, so those of the most frequent count grow out of the shortest ones.
    """
    counts = {sub: text.count(sub) for sub in {text[i : i + least] for i in range(len(text) - least + 1)}}
    if not counts:
        return None
    most = max(counts.values())
    if most == 1:
        return text
    best = {sub for sub, n in counts.items() if n == most}
    size = least
    while True:
        size += 1
        longer = {text[i : i + size] for i in range(len(text) - size + 1) if text[i : i + size - 1] in best}
        longer = {sub for sub in longer if text.count(sub) == most}
        if not longer:
            return min(best)
        best = longer
