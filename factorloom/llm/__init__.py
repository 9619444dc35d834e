"""Training-data operators: licences, tokens, duplicates, languages, mixing, secrets, chats.

Nothing outside this subpackage imports it.
"""
