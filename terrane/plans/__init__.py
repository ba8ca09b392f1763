"""Queries over the library's operators; importing the package registers all of them."""

from . import access, cleaning, coverage, graphs, integrity, network, planning, routes, shapes, texts, typology  # noqa: F401
