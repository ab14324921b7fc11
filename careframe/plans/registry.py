"""All registered queries, gathered from the case modules."""

from __future__ import annotations

from careframe.plans import cases_files, cases_kept, cases_patients, cases_places, cases_prepare, cases_reports, cases_scoring

MODULES = (cases_reports, cases_patients, cases_scoring, cases_prepare, cases_places, cases_files, cases_kept)


def cases() -> dict[str, tuple]:
    found: dict[str, tuple] = {}
    for module in MODULES:
        clash = set(found) & set(module.CASES)
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        found.update(module.CASES)
    return found
