"""One island of the grouping genetic algorithm for bin packing: plain Python on a block of bounded size."""

from __future__ import annotations

import random


class _Room:
    """Bins by the room left in them; the tightest bin that takes a size is one bit operation away."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.at = capacity, 0, [[] for _ in range(capacity + 1)]

    def put(self, room: int, name: int) -> None:
        self.at[room].append(name)
        self.mask |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        above = self.mask >> size
        if not above:
            return None
        room = size + (above & -above).bit_length() - 1
        name = self.at[room].pop()
        if not self.at[room]:
            self.mask &= ~(1 << room)
        return room, name


def best_fit(bins: list[list[int]], items: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """The bins with the items put in one after another, each where it leaves the least room."""
    room = _Room(capacity)
    for name, held in enumerate(bins):
        room.put(capacity - sum(sizes[i] for i in held), name)
    for i in items:
        found = room.take(sizes[i])
        if found is None:
            bins.append([i])
            room.put(capacity - sizes[i], len(bins) - 1)
        else:
            bins[found[1]].append(i)
            room.put(found[0] - sizes[i], found[1])
    return bins


def score(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, int]:
    """Fewer bins first, then bins that are full rather than even (sum of squared fills); higher is better."""
    return -len(bins), sum(sum(sizes[i] for i in held) ** 2 for held in bins)


def cross(mother: list[list[int]], father: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Well-filled bins of the father go whole into the mother; her bins that share a document with them are broken up,
    and the documents displaced that way are best-fitted, large ones first."""
    ranked = sorted(father, key=lambda held: -sum(sizes[i] for i in held))
    full = ranked[:max(1, len(ranked) // 2)]
    a = rng.randrange(len(full))
    given = full[a:a + max(1, len(full) // 4)]
    have = {i for held in given for i in held}
    kept, displaced = [], []
    for held in mother:
        if have.isdisjoint(held):
            kept.append(list(held))
        else:
            displaced.extend(i for i in held if i not in have)
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(kept + [list(held) for held in given], displaced, sizes, capacity)


def mutate(bins: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """The emptiest bins and a few others are broken up and their documents best-fitted again."""
    ranked = sorted(bins, key=lambda held: sum(sizes[i] for i in held))
    cut = max(1, len(ranked) // 50)
    broken = ranked[:cut]
    rest = ranked[cut:]
    for _ in range(min(cut, len(rest) - 1)):
        broken.append(rest.pop(rng.randrange(len(rest))))
    loose = [i for held in broken for i in held]
    rng.shuffle(loose)
    loose.sort(key=lambda i: -sizes[i] + rng.randrange(-8, 9))
    return best_fit([list(held) for held in rest], loose, sizes, capacity)


def evolve(sizes: list[int], capacity: int, population: list[list[list[int]]], generations: int, size: int, seed: int) -> list[list[list[int]]]:
    """The population after some generations, best first. Without one, it starts from best-fit decreasing and perturbed orders."""
    rng = random.Random(seed)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    if not population:
        population = [best_fit([], order, sizes, capacity)]
    while len(population) < size:
        blur = capacity // 16 * len(population)
        population.append(best_fit([], sorted(order, key=lambda i: -sizes[i] + rng.randrange(-blur, blur + 1)), sizes, capacity))
    floor = -(-sum(sizes) // capacity)
    rated = sorted(((score(p, sizes, capacity), k, p) for k, p in enumerate(population)), key=lambda x: (x[0], -x[1]), reverse=True)
    made = len(rated)
    for _ in range(generations):
        if -rated[0][0][0] <= floor:
            break
        mother, father = rng.sample(rated[:size], 2) if len(rated) > 1 else (rated[0], rated[0])
        for child in (cross(mother[2], father[2], sizes, capacity, rng), mutate(rated[0][2], sizes, capacity, rng)):
            rated.append((score(child, sizes, capacity), made, child))
            made += 1
        rated.sort(key=lambda x: (x[0], -x[1]), reverse=True)
        rated = rated[:size]
    return [p for _, _, p in rated]
