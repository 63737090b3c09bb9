"""Training-data operators at corpus scale.

Nothing outside this subpackage imports it. Each module holds one operator with
its own general interface; ``catalog`` turns them into the registered queries.
"""
