"""Keyed state carried between rounds.

The original pipeline has no stream or event-time processing. What it does
keep between calls is a per-client state: the exponential moving average of
the client's profile, updated at every (re)clustering. ``ema_stream`` holds
that in a state store, fed by the stream of the rounds' vectors.
"""
