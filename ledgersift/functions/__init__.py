from ledgersift.functions.labels import ENGLISH, SPANISH_EXPORT, Labels

__all__ = ["ENGLISH", "SPANISH_EXPORT", "Labels"]
