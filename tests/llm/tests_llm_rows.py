from conftest import CLASHING, ROWS  # noqa: F401
