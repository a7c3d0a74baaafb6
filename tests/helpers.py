"""What several tests use."""


def rows(df) -> list[tuple]:
    """The rows of a frame as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
