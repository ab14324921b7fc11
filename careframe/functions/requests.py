"""Classification of web requests for the audit trail."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Path prefixes that are never audited.
SKIPPED_PREFIXES = ("/static/", "/media/", "/admin/jsi18n/")

# Path fragments and the action they mean, first match wins.
PATH_ACTIONS = (
    ("predict", "predict"),
    ("login", "login"),
    ("logout", "logout"),
    ("export", "export"),
    ("report", "export"),
)

# Methods and the action they mean where no fragment matched.
METHOD_ACTIONS = {"POST": "create", "PUT": "update", "PATCH": "update", "DELETE": "delete"}
OTHER_ACTION = "read"

# Path fragments and the resource they mean, first match wins.
PATH_RESOURCES = (
    ("patients", "Patient"),
    ("predictions", "Prediction"),
    ("clinicians", "Clinician"),
    ("reports", "Report"),
)
OTHER_RESOURCE = "Unknown"

ANONYMOUS = "Anonymous"
AGENT_LENGTH = 500
BLANKS = " \t\n\r\x0b\x0c"


def _first_fragment(path: Column, table) -> Column:
    return F.coalesce(*[F.when(F.contains(path, F.lit(part)), F.lit(name)) for part, name in table])


def audit_action(method: Column, path: Column) -> Column:
    by_method = F.coalesce(*[F.when(method == m, F.lit(a)) for m, a in METHOD_ACTIONS.items()])
    return F.coalesce(_first_fragment(path, PATH_ACTIONS), by_method, F.lit(OTHER_ACTION))


def audit_resource(path: Column) -> Column:
    return F.coalesce(_first_fragment(path, PATH_RESOURCES), F.lit(OTHER_RESOURCE))


def client_ip(forwarded: Column, remote: Column) -> Column:
    """First hop of the forwarded header when there is one, else the peer address."""
    first_hop = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)), F.lit(BLANKS))
    return F.when(F.length(forwarded) > 0, first_hop).otherwise(remote)


def is_audited(path: Column) -> Column:
    skipped = F.lit(False)
    for prefix in SKIPPED_PREFIXES:
        skipped = skipped | F.startswith(path, F.lit(prefix))
    return ~skipped


def audit_user(user_id: Column, full: Column, username: Column) -> Column:
    named = F.coalesce(F.nullif(F.trim(full, F.lit(BLANKS)), F.lit("")), username)
    return F.when(user_id.isNotNull(), named).otherwise(F.lit(ANONYMOUS))
