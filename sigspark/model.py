"""Schemas of the tables that operators exchange."""

from __future__ import annotations

RECORDING = "rec_id string, dt double, polarity string, nchan int, nsamples long, processing array<struct<operation:string,params:map<string,string>>>"
TRACE = "rec_id string, channel int, t long, v double"
INTERVALS = "rec_id string, island_id long, start long, end long, len long"
SNIPPETS = "rec_id string, snip_id long, center long, len int, data array<array<double>>"
VECTORS = "snip_id long, features array<double>, label int"
WAVEFORMS = "cell_id int, w array<array<double>>"
SPIKES = "cell_id int, t double, amp double"
MATCHES = "cell_id int, est_idx long, true_idx long"
