"""The library's tables between steps, by the name that the operators here use."""

from nearfield.storage import BOUNDS, Scratch, bounded_batches, remove, shared_folder, stored

__all__ = ["BOUNDS", "Scratch", "bounded_batches", "remove", "shared_folder", "stored"]
