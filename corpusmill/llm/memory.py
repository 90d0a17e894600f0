"""What keeps a Python worker small; see ``corpusmill.memory``."""

from corpusmill.memory import BATCH_ROWS, SETTING, give_back, short_batches

__all__ = ["BATCH_ROWS", "SETTING", "give_back", "short_batches"]
