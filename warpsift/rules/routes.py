"""Route-handler rule. Method names are fixed values."""

from .base import CRITICAL, OTHER, Pack

PACK = Pack("routes", "business-logic", None)
PACK.add("route_no_auth", CRITICAL, "authorization", emits=OTHER,
         title="Route changes data without looking at the caller",
         fix="Add an access check before the handler or read the caller inside it.",
         better="Guard every changing route with the same middleware.")

ROUTE_METHODS = ("post", "put", "patch", "delete")
WRITE_METHODS = ("update", "save", "insert", "delete", "destroy")
