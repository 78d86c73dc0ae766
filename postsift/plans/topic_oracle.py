"""Fitting and applying topics in plain SQL, step by step as the operator defines it."""

from __future__ import annotations

from postsift.defaults import FOLD_STEPS, MIN_DOCS, TOPIC_WORDS
from postsift.operators.topics import WEIGHT_DECIMALS


def _each(k: int, expression: str) -> str:
    """``expression`` per topic, as columns t0, t1, ..."""
    return ", ".join(f"{expression.format(t=t, topic=t + 1)} AS t{t}" for t in range(k))


def model(k: int, passes: int, seed: int = 11, steps: int = FOLD_STEPS) -> list[str]:
    """Common table expressions after ``posts`` and ``cleaned``.

    ``place`` numbers the known words, ``fitted`` has their weights and ``mass`` the words of each
    topic; ``assigned`` has the largest topic of every text with a known word.
    """
    smoothing = f"(1.0::DOUBLE / {k})"
    ctes = [
        f"""place AS MATERIALIZED (
    SELECT token, row_number() OVER (ORDER BY count(DISTINCT id) DESC, token) AS word FROM cleaned GROUP BY token
    HAVING count(DISTINCT id) >= {MIN_DOCS} AND count(DISTINCT id) <= 0.5 * (SELECT count(*) FROM posts)
)""",
        "bag AS MATERIALIZED (SELECT id, word, count(*) AS n FROM cleaned JOIN place USING (token) GROUP BY id, word)",
        f"noise AS (SELECT word, {_each(k, f'(word * (2 * {{topic}} + 1) * 7919 + {{topic}} * {seed} * 104729) % 65521')} FROM place)",
        f"raw AS (SELECT word, {_each(k, '0.5::DOUBLE + (t{t} * t{t} % 65521)::DOUBLE / 65521')} FROM noise)",
        f"weights0 AS MATERIALIZED (SELECT word, {_each(k, 't{t} / sum(t{t}) OVER ()')} FROM raw)",
        f"sizes0 AS MATERIALIZED (SELECT DISTINCT id, {_each(k, '1.0::DOUBLE')} FROM bag)",
    ]
    total = "(" + " + ".join(f"s.t{t} * w.t{t}" for t in range(k)) + ")"
    dealt = f"sum(n * s.t{{t}} * w.t{{t}} / {total})"

    def source(sizes: str, weights: str) -> str:
        return f"FROM bag JOIN {sizes} s USING (id) JOIN {weights} w USING (word)"

    def adjusted(name: str, weights: str, times: int) -> str:
        """The table of sizes after so many steps from equal ones."""
        before = "sizes0"
        for step in range(1, times + 1):
            after = f"{name}_{step}"
            ctes.append(
                f"{after} AS MATERIALIZED (SELECT id, {_each(k, f'{smoothing} + {dealt}')} "
                f"{source(before, weights)} GROUP BY id)"
            )
            before = after
        return before

    weights = "weights0"
    for turn in range(1, passes + 1):
        sizes = adjusted(f"sizes{turn}", weights, steps - 1)
        ctes.append(
            f"dealt{turn} AS MATERIALIZED (SELECT word, {_each(k, dealt)} {source(sizes, weights)} GROUP BY word)"
        )
        words = "(SELECT count(*) FROM place)"
        ctes.append(
            f"weights{turn} AS MATERIALIZED (SELECT word, "
            + _each(k, f"(t{{t}} + {smoothing}) / (sum(t{{t}}) OVER () + {words} * {smoothing})")
            + f" FROM dealt{turn})"
        )
        weights = f"weights{turn}"
    sizes = adjusted("sizes", weights, steps)
    largest = "greatest(" + ", ".join(f"t{t}" for t in range(k)) + ")"
    first = "CASE " + " ".join(f"WHEN t{t} = {largest} THEN {t}" for t in range(k)) + " END"
    masses = ", ".join(f"sum(t{t}) AS t{t}" for t in range(k))
    ctes += [
        f"fitted AS (SELECT * FROM {weights})",
        f"most AS (SELECT {first} AS topic FROM (SELECT {masses} FROM dealt{passes}))",
        f"assigned AS (SELECT id, {first}::INT AS topic_id FROM {sizes})",
    ]
    return ctes


def labels(k: int, words: int = TOPIC_WORDS) -> str:
    """The table expression ``labels`` (topic_id, topic_words) from ``fitted``."""
    listed = " UNION ALL ".join(f"SELECT word, {t}::INT AS topic_id, t{t} AS weight FROM fitted" for t in range(k))
    return f"""labels AS (
    SELECT topic_id, string_agg(token, ' ' ORDER BY nth) AS topic_words FROM (
        SELECT topic_id, token,
            row_number() OVER (PARTITION BY topic_id ORDER BY round(weight, {WEIGHT_DECIMALS}) DESC, token) AS nth
        FROM ({listed}) JOIN place USING (word)
    ) WHERE nth <= {words} GROUP BY topic_id
)"""
