"""Operators for building training data from large document collections.

Nothing outside this folder imports it.  ``queries`` holds the registered
queries; each operator lives in a module of its own and keeps a general
DataFrame interface.
"""
