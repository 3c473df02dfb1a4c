"""Operators for preparing language-model training data; nothing else in keepset imports this subpackage."""
