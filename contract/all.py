from contract import allocation, audio, filters, intervals, plans, registry, sequences, sources  # noqa: F401
from contract.base import ORACLES, QUERIES, SURVEY_IDS  # noqa: F401
