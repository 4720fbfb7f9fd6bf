"""Registered queries; importing the package fills the registry."""

from postmeter.workloads import bodies, headers, mailbox, metrics, reports, stores, streams, web  # noqa: F401
from postmeter.workloads.registry import ORACLES, QUERIES  # noqa: F401
