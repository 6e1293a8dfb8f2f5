"""SQL of the generator: layers as joins of pixels with weights, apart from the library's own kernels."""

from __future__ import annotations


def unet(name: str, source: str, side: int, depth: int, latent: int = 8, width: int = 2, salt: int = 0) -> str:
    """Common tables that end in ``name`` (t, y, x, v): ``unet.fixed_weights`` over tiles.

    ``source`` is a table (t, c, y, x, v) of tiles of side x side pixels with 1 + latent channels.
    """
    steps: list[tuple[str, str]] = []

    def add(suffix: str, sql: str) -> str:
        steps.append((f"{name}_{suffix}", sql))
        return f"{name}_{suffix}"

    def weights(k: int, made: int, taken: int) -> str:
        value = f"(((o * 31 + c * 17 + i * 7 + j * 3 + {k * 13 + salt}) * 37 % 101) - 50) / 200.0::DOUBLE"
        axis = lambda n, a: f"(SELECT unnest(range({n})) AS {a})"
        return add(f"w{k}", f"SELECT o, c, i, j, {value} AS w FROM {axis(made, 'o')}, {axis(taken, 'c')}, {axis(4, 'i')}, {axis(4, 'j')}")

    def finished(k: int, norm: bool) -> str:
        """Bias and normalisation of a sum of products s."""
        biased = f"s + ((o * 11 + {k * 5 + salt}) % 7 - 3) / 20.0::DOUBLE"
        if not norm:
            return biased
        return f"({biased} - ((o + {k}) % 3 - 1) / 10.0::DOUBLE) * (1 + o % 3 / 4.0::DOUBLE) / sqrt(1 + o % 2 / 2.0::DOUBLE + 1e-5) + ((o * 5 + {k}) % 5 - 2) / 10.0::DOUBLE"

    leaky = lambda t: f"SELECT t, c, y, x, CASE WHEN v > 0 THEN v ELSE 0.2::DOUBLE * v END AS v FROM {t}"
    x, skips, n = source, [], side
    for k in range(depth):
        if k:
            x = add(f"a{k}", leaky(x))
            skips.append(x)
        w = weights(k, width, width if k else 1 + latent)
        sums = f"""SELECT t, o, (y + 1 - i) // 2 AS y, (x + 1 - j) // 2 AS x, sum(v * w) AS s FROM {x} JOIN {w} USING (c)
          WHERE (y + 1 - i) % 2 = 0 AND (x + 1 - j) % 2 = 0 AND y + 1 - i BETWEEN 0 AND {n - 2} AND x + 1 - j BETWEEN 0 AND {n - 2} GROUP BY ALL"""
        x = add(f"d{k}", f"SELECT t, o AS c, y, x, {finished(k, 0 < k < depth - 1)} AS v FROM ({sums})")
        n //= 2
    for u in range(depth):
        relu = f"SELECT t, c, y, x, greatest(v, 0) AS v FROM {x}"
        if u:
            skip = "v" if u == depth - 1 else "greatest(v, 0)"
            relu += f" UNION ALL SELECT t, c + {width}, y, x, {skip} FROM {skips[-u]}"
        x = add(f"r{u}", relu)
        k, last = depth + u, u == depth - 1
        w = weights(k, 1 if last else width, 2 * width if u else width)
        sums = f"""SELECT t, o, 2 * y + i - 1 AS y, 2 * x + j - 1 AS x, sum(v * w) AS s FROM {x} JOIN {w} USING (c)
          WHERE 2 * y + i - 1 BETWEEN 0 AND {2 * n - 1} AND 2 * x + j - 1 BETWEEN 0 AND {2 * n - 1} GROUP BY ALL"""
        x = add(f"u{u}", f"SELECT t, o AS c, y, x, {finished(k, not last)} AS v FROM ({sums})")
        n *= 2
    made = ", ".join(f"{a} AS MATERIALIZED ({sql})" for a, sql in steps)
    return f"{made}, {name} AS MATERIALIZED (SELECT t, y, x, tanh(v) AS v FROM {x})"
