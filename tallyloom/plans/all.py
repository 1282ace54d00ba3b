"""Imports every query module so that the book is full."""

from tallyloom.plans import campaigns, chats, reporting, requests, scalars, sightings, streams, upkeep, vehicles  # noqa: F401
from tallyloom.plans.book import BOOK

__all__ = ["BOOK"]
