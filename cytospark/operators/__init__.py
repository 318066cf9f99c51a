"""DataFrame operators on reads, bases, cytosines and sites."""
