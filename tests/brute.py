"""The method restated bin by bin in plain Python, slow and without state classes: what the fast forms are held against."""

import cmath
import math

EPS, TINY = 1e-12, 1.17549435e-38


def smooth3(x, share):
    out = []
    for k in range(len(x)):
        near = [x[j] for j in (k - 1, k, k + 1) if 0 <= j < len(x)]
        out.append(share * sum(near) / len(near) + (1 - share) * x[k])
    return out


def fill(x, least):
    out, k = list(x), 1
    while k < len(x) - 1:
        if x[k] >= least:
            k += 1
            continue
        right = next((j for j in range(k, len(x)) if x[j] >= least), None)
        if right is None:
            break
        left = k - 1
        for j in range(k, min(right, len(x) - 1)):
            out[j] = x[left] + (x[right] - x[left]) * (j - left) / (right - left)
        k = right
    return out


def spp(frames):
    noise = presence = None
    for x in frames:
        if sum(x) / len(x) < 1e-10:
            yield list(noise or [0.0] * len(x))
            continue
        if noise is None:
            noise, presence = list(x), [0.0] * len(x)
            yield list(noise)
            continue
        for k, v in enumerate(x):
            p = 1 / (1 + 32.62 * math.exp(-v / max(noise[k], EPS) * 31.62 / 32.62))
            presence[k] = 0.9 * presence[k] + 0.1 * p
            if presence[k] > 0.99:
                p = min(p, 0.99)
            noise[k] = 0.8 * noise[k] + 0.2 * ((1 - p) * v + p * noise[k])
        yield list(noise)


def martin(frames):
    power = low = history = None
    at = count = 0
    for x in frames:
        silent = sum(x) / len(x) < 1e-10
        if power is None:
            if silent:
                yield [0.0] * len(x)
                continue
            power = [v / 1.5 for v in x]
            low, history, count = list(power), [list(power) for _ in range(8)], 0
            yield list(x)
            continue
        if not silent:
            power = [0.8 * p + 0.2 * v for p, v in zip(power, x, strict=True)]
            low = [min(a, b) for a, b in zip(low, power, strict=True)]
            if count >= 12:
                history[at], at, low, count = list(low), (at + 1) % 8, list(power), 0
        count += 1
        yield [1.5 * min(a, *(h[k] for h in history)) for k, a in enumerate(low)]


def correction(p):
    return 1.0 if p >= 1 else 1 / (1 + (1 - p) / p * math.log(1 - p))


def brandt(frames, size):
    history, last, at = None, [0.0] * len(frames[0]), 0
    for x in frames:
        energy = sum(x) / len(x)
        if history is None and energy > 1e-10:
            history = [[v / correction(0.5) * (1 + 0.01 * ((t + k) % 11 - 5) / 5) for t in range(size)] for k, v in enumerate(x)]
            last = list(x)
        if energy < 1e-10:
            yield list(last)
            continue
        for k, v in enumerate(x):
            history[k][at] = v
            ordered = sorted(history[k])
            best, value = 2.0, last[k]
            for share in (0.1, 0.25, 0.5, 0.75, 1.0):
                q = int(share * size + 1e-6)
                if q < 10:
                    continue
                low = sum(ordered[:q]) / q
                if low <= 1e-10:
                    continue
                mean = low * correction(share)
                whole = 1 - math.exp(-ordered[q - 1] / mean)
                if abs(whole) < EPS:
                    misfit = 1.0
                else:
                    misfit = 2 / q * sum(abs((i + 1) / q - (1 - math.exp(-ordered[i] / mean)) / whole) for i in range(q))
                if misfit < best:
                    best, value = misfit, mean
            if 1 - best >= 0.9:
                last[k] = value
        at = (at + 1) % size
        yield list(last)


def shown(estimate):
    """What the adaptive face gives of an estimate."""
    return smooth3(fill(estimate, 1e-9), 0.5)


def band_thresholds(x, ranges):
    energy = [sum(x[lo:hi]) for lo, hi in ranges]
    out = []
    for i, (lo, hi) in enumerate(ranges):
        total = 0.0
        for j, e in enumerate(energy):
            level = 10 * math.log10(e + EPS) + 96
            up = min(max(15 - (level - 40) * 0.2, 5), 15)
            y = i - j + 0.474
            total += (e * 10 ** ((15.81 + (25 - up) / 2 * y - (25 + up) / 2 * math.sqrt(1 + y * y)) / 10)) ** 0.4
        spread = total**2.5
        v = [max(b, EPS) for b in x[lo:hi]]
        if hi - lo <= 1:
            tone = 1.0
        else:
            tone = min(max(10 * (sum(math.log10(b) for b in v) / len(v) - math.log10(sum(v) / len(v))) / -60, 0), 1)
        offset = tone * (14.5 + min(i + 1, 25)) + 6 * (1 - tone)
        out.append(10 ** (math.log10(spread + EPS) - offset / 10))
    return out


def hearing(rate, fft):
    """Floor in dB by bin and the level of full power."""
    floor = []
    for k in range(fft // 2 + 1):
        f = max(k * rate / fft, 20) / 1000
        floor.append(3.64 * f**-0.8 - 6.5 * math.exp(-0.6 * (f - 3.3) ** 2) + 1e-3 * f**4)
    sine = [math.sin(2 * math.pi * n * 1000 / rate) * math.sin(math.pi / 2 * math.sin(math.pi * n / fft) ** 2) for n in range(fft)]
    top = max(abs(sum(s * cmath.exp(-2j * math.pi * k * n / fft) for n, s in enumerate(sine))) ** 2 for k in range(fft // 2 + 1))
    return floor, 90 - 10 * math.log10(top + EPS)


class Mask:
    def __init__(self, rate, fft, ranges):
        self.ranges, self.hop, self.before = ranges, fft / (4 * rate), [0.0] * len(ranges)
        self.floor, self.reference = hearing(rate, fft)

    def __call__(self, x, ahead=None):
        now = band_thresholds(x, self.ranges)
        later = band_thresholds(ahead, self.ranges) if ahead is not None else None
        out = [0.0] * len(x)
        for j, (lo, hi) in enumerate(self.ranges):
            w = min(j, 24) / 24
            total = now[j] ** 0.6 + (self.before[j] * math.exp(-self.hop / ((1 - w) * 0.1 + w * 0.025))) ** 0.6
            if later is not None:
                total += (later[j] * math.exp(-self.hop / 0.01)) ** 0.6
            self.before[j] = total ** (1 / 0.6)
            for k in range(lo, hi):
                level = max(10 * math.log10(self.before[j] + EPS) + self.reference, self.floor[k])
                out[k] = max(10 ** ((level - self.reference) / 10) - EPS, 0)
        return out


class Vetoed:
    def __init__(self, rate, fft, ranges):
        self.mask, self.ranges = Mask(rate, fft, ranges), ranges
        self.clean, self.memory = [0.0] * (fft // 2 + 1), [0.0] * len(ranges)

    def __call__(self, x, noise, alpha, depth, ahead=None):
        self.clean = [0.5 * max(a - n, 0) + 0.5 * c for a, n, c in zip(x, noise, self.clean, strict=True)]
        threshold = self.mask(self.clean, None if ahead is None else [max(a - n, 0) for a, n in zip(ahead, noise, strict=True)])
        for j, (lo, hi) in enumerate(self.ranges):
            protection = 0.0
            if hi > lo:
                nmr = 10 * math.log10((sum(noise[lo:hi]) + EPS) / (sum(threshold[lo:hi]) + EPS))
                protection = min(max(1 - nmr / 20, 0), 1)
            self.memory[j] = 0.5 * protection + 0.5 * self.memory[j]
        m = self.memory
        flat = [m[0]] + [0.25 * m[j - 1] + 0.5 * m[j] + 0.25 * m[min(j + 1, len(m) - 1)] for j in range(1, len(m))]
        at = [lo + (hi - lo) / 2 for lo, hi in self.ranges]
        out = []
        for k, a in enumerate(alpha):
            j = 0
            while j < len(at) - 1 and k > at[j + 1]:
                j += 1
            p = flat[j]
            if j < len(at) - 1 and at[j + 1] > at[j]:
                t = min(max((k - at[j]) / (at[j + 1] - at[j]), 0), 1)
                p = flat[j] * (1 - t) + flat[j + 1] * t
            share = p * min(self.clean[k] / (noise[k] + EPS), 1) * depth
            out.append(a + (1 - a) * share)
        return out


def aware(frames, ranges, smoothing):
    average, before = None, [0.0] * len(frames[0])
    for x in frames:
        energy = [sum(x[lo:hi]) for lo, hi in ranges]
        average = average or list(energy)
        out = list(before)
        for j, (lo, hi) in enumerate(ranges):
            e = energy[j]
            onset = 0.0 if e < 1e-10 else min(max((e / (average[j] + 1e-9) - 1) / 0.25, 0), 1)
            a = 0.4 if onset > 0 else 0.8
            average[j] = e * (1 - a) + average[j] * a
            for k in range(lo, hi):
                s = smoothing * (1 - onset)
                out[k] = s * before[k] + (1 - s) * x[k] if x[k] > before[k] else x[k]
        before = out
        yield list(out)


def quick_exp(x):
    import struct

    if x < -20:
        return 0.0
    single = struct.unpack("f", struct.pack("f", x))[0]
    product = struct.unpack("f", struct.pack("f", struct.unpack("f", struct.pack("f", 12102203.0))[0] * single))[0]
    total = struct.unpack("f", struct.pack("f", product + 1064866816.0))[0]  # as a single: ...805 rounds to ...816
    return struct.unpack("f", struct.pack("I", int(max(total, 0))))[0]


def similar(frames, h, past=16, future=4, reach=8):
    """The filter of each frame once the ring of ``past + future + 1`` is full; None before."""
    size, n = past + future + 1, len(frames[0])
    for now in range(len(frames)):
        if now + 1 < size:
            yield None
            continue
        # The target is ``future`` frames back; the ring holds the last ``size`` frames and wraps.
        ring = frames[now + 1 - size : now + 1]
        frame = lambda dt: ring[(past + dt) % size]
        bin_at = lambda k: min(max(k, 0), n - 1)
        target, out, weight = frame(0), [0.0] * n, [0.0] * n
        for start in range(0, n, 8):
            center, stop = min(start + 4, n - 1), min(start + 8, n)
            if sum(target[start:stop]) < 1e-6:
                continue
            scale = 1 + 3 * (center / (n - 1)) ** 2
            h2 = (h * scale) ** 2
            own = [[frame(r)[bin_at(center + c)] for c in range(-4, 4)] for r in range(-4, 4)]
            for dt in range(-past, future + 1):
                rows = [frame(dt + r) for r in range(-4, 4)]
                for df in range(-reach, reach + 1):
                    there = bin_at(center + df)
                    distance = sum((own[r][c] - rows[r][bin_at(there + c - 4)]) ** 2 for r in range(8) for c in range(8))
                    if distance > 4 * h2:
                        continue
                    w = quick_exp(-distance / h2)
                    if w < 1e-10:
                        continue
                    for k in range(start, stop):
                        out[k] += w * frame(dt)[bin_at(k + df)]
                        weight[k] += w
        yield [o / w if w > 1e-10 else t for o, w, t in zip(out, weight, target, strict=True)]


def tonal(profile):
    out = []
    for k, v in enumerate(profile):
        near = sorted(profile[min(max(j, 0), len(profile) - 1)] for j in range(k - 25, k + 26))
        floor = near[25]
        out.append((v - floor) / v if v - floor >= 1e-7 and v > 1.41 * max(floor, EPS) else 0.0)
    return out


class Chain:
    """One stream, manual profile; parameters in linear units."""

    def __init__(self, rate, fft, ranges, p, two_d):
        self.p, self.two_d, self.bins = p, two_d, fft // 2 + 1
        self.veto = Vetoed(rate, fft, ranges)
        self.seen, self.smooth, self.late, self.ratios = [], [0.0] * self.bins, [], []
        self.profile = None

    def learn(self, x):
        self.seen.append(x)

    def learned(self):
        n, bins = len(self.seen), range(self.bins)
        mean = list(self.seen[0])
        for i in range(1, n):
            mean = list(self.seen[i]) if i < 2 else [m + (v - m) / i for m, v in zip(mean, self.seen[i], strict=True)]
        recent = self.seen[-25:]
        median = [sorted([f[k] for f in recent] + [0.0] * (25 - len(recent)))[12] for k in bins]
        top, low = ([f(0.0, *(s[k] for s in self.seen)) for k in bins] for f in (max, min))
        tidy = lambda x, ok: shown(x) if ok else x
        mean, median, top, low = tidy(mean, n > 5), tidy(median, True), tidy(top, True), tidy(low, True)
        self.profile = [max(m, v) for m, v in zip(mean, low, strict=True)]
        self.source = top if any(v > 0 for v in median) else self.profile

    def gains(self, x, noise, ahead=None):
        p = self.p
        most = 1 + 3 * p["strength"]
        alpha = []
        for v, n in zip(x, noise, strict=True):
            db = 10 * math.log10(v / (n + EPS)) if v > 0 else -1e9
            alpha.append(most if db <= -5 else 1.0 if db >= 20 else most - (db + 5) / 25 * (most - 1))
        mask = tonal(self.source)
        if p["tonal"] < 0.999:
            alpha = [max(a, 1 + m * (1 - p["tonal"]) * 9) if m > 0 else a for a, m in zip(alpha, mask, strict=True)]
        if not self.two_d:
            s = p["smoothing"]
            self.smooth = x = [s * b + (1 - s) * v if v > b else v for v, b in zip(x, self.smooth, strict=True)]
        alpha = self.veto(x, noise, alpha, p["depth"], ahead)
        gain = []
        for v, n, a in zip(x, noise, alpha, strict=True):
            m = a * n
            gain.append(1.0 if m <= TINY else (v - m) / v if v > m else 0.0)
        if p["reduction"] >= 0.999 and p["tonal"] >= 0.999:
            return [1.0] * self.bins
        flat = smooth3(noise, 0.5)
        anchor = max(sorted(flat)[len(flat) // 2], EPS)
        out = []
        for g, m, v in zip(gain, mask, flat, strict=True):
            weight = (anchor / v) ** p["whitening"] if p["whitening"] > 0 and v > EPS else 1.0
            t = max(m, 0) ** 0.25
            path = p["reduction"] * (1 - t) + p["tonal"] * t
            aim = path + p["whitening"] * (p["reduction"] - path)
            out.append(max(min(aim * (1 + (1 - aim) * (weight - 1)), 1), g))
        return out

    def step(self, z, learning):
        x = [abs(v) ** 2 for v in z]
        if learning:
            self.learn(x)
            return z
        if self.profile is None:
            self.learned()
        if not self.two_d:
            return [v * g for v, g in zip(z, self.gains(x, self.profile), strict=True)]
        self.late.append(z)
        self.ratios.append([v / max(n, 1e-9) for v, n in zip(x, self.profile, strict=True)])
        late = self.late[-5] if len(self.late) > 4 else [0j] * self.bins
        *_, smooth = similar(self.ratios[-21:], self.p["h"])
        if smooth is None:
            return late
        rebuilt = [r * max(n, 1e-9) for r, n in zip(smooth, self.profile, strict=True)]
        return [v * g for v, g in zip(late, self.gains(rebuilt, self.profile, [v.real for v in late]), strict=True)]


def denoised(signal, rate, frame, hop, fft, ranges, p, learn, two_d):
    """Frames, transform, chain, inverse, overlap-add, all by definition."""
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * k / frame) for k in range(frame)]
    scale = sum(w * w for w in hann) / hop
    chain, out = Chain(rate, fft, ranges, p, two_d), [0.0] * (len(signal) + 2 * frame)
    begin, half = fft // 2 - frame // 2, fft // 2
    turn = [cmath.exp(-2j * math.pi * i / fft) for i in range(fft)]
    for n in range(len(signal) // hop):
        x = [signal[i] if i >= 0 else 0.0 for i in range((n + 1) * hop - frame, (n + 1) * hop)]
        z = [sum(v * w * turn[k * (begin + i) % fft] for i, (v, w) in enumerate(zip(x, hann, strict=True))) for k in range(half + 1)]
        y = chain.step(z, (n + 1) * hop <= learn)
        for i in range(frame):
            t = begin + i
            total = y[0].real + y[half].real * (-1) ** t + 2 * sum((y[k] * turn[-k * t % fft]).real for k in range(1, half))
            out[(n + 1) * hop + i] += total / fft * hann[i] / scale
    return out[: len(signal)]
