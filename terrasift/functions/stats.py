"""Statistics as SQL expressions."""

Z95 = 1.96  # fixed value


def wilson(successes: str, total: str, z: float = Z95) -> tuple[str, str]:
    """Bounds of the Wilson interval, clamped to [0, 1]; 0, 0 for an empty sample."""
    p = f"(cast({successes} AS double) / {total})"
    zz = f"{z * z!r}D"
    denom = f"(1 + {zz} / {total})"
    centre = f"(({p} + {zz} / (2 * {total})) / {denom})"
    spread = f"({z!r}D * sqrt({p} * (1 - {p}) / {total} + {zz} / (4 * {total} * {total})) / {denom})"
    return (
        f"CASE WHEN {total} = 0 THEN 0D ELSE greatest(0D, {centre} - {spread}) END",
        f"CASE WHEN {total} = 0 THEN 0D ELSE least(1D, {centre} + {spread}) END",
    )


def rounded(expr: str, digits: int = 4) -> str:
    return f"floor(({expr}) * 1e{digits}D + 0.5D) / 1e{digits}D"
