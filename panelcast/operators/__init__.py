"""DataFrame -> DataFrame operators; each is usable with ``df.transform``."""
