"""All registered queries; importing a module here registers its own."""

from . import bytes_and_text, content, cross, evaluation, images, pdf, placement, records, relations, scoring, security, services
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "bytes_and_text", "content", "cross", "evaluation", "images", "pdf", "placement", "records", "relations", "scoring", "security", "services"]
