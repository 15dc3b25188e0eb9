"""Errors with the exit code that the command line gives for them."""

OK, CONFIG, RUNTIME, ALLOWLIST, LEDGER, GAPS_REMAIN, INVARIANT, CONSUMER, EVALUATION = 0, 2, 3, 4, 5, 10, 20, 30, 40


class SeedloomError(Exception):
    code = RUNTIME


class ConfigError(SeedloomError):
    """Bad DDL, rules or options."""

    code = CONFIG


class GenerationError(SeedloomError):
    code = CONFIG


class AllowlistError(SeedloomError):
    code = ALLOWLIST


class LedgerConflict(SeedloomError):
    """An identity differs from what the append-only ledger holds."""

    code = LEDGER
